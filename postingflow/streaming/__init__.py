"""Documents that arrive in a stream."""
