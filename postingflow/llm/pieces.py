"""Exact SentencePiece BPE encoding by backtracking, and decoding, for merge-type models.

A segment (the word marks and the letters after them; no piece of such a model spans more) is encoded from left to
right: all pieces that match at each position come from one Aho-Corasick pass, the longest is tried first, and it stands
if it is compatible with the piece before it, that is if merging the two pieces' characters anew gives the same two
pieces. If none stands, the position is marked in a bitfield as failed and the piece before is shortened. The result is
that of the merge loop, without a heap and without merging the text.

A batch is cut into words by Arrow; every different word is encoded once, and ids are gathered by numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import flat, slices
from ._spark import of_row, packed, table, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 1 << 19  # words whose ids a worker remembers; more are encoded again
SLICE = 4 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The pieces of a model; small, and sent to the workers as they are."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]) -> None:
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.score = {p: s for p, s, k in zip(pieces, scores, kinds) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.whole = [p for p in self.id if self.merge(p) == [p]]  # others never come out of the merge loop
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces span words; this model isn't split by white space")

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        kinds = [UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) or sp.is_unused(i) else BYTE if sp.is_byte(i) else NORMAL for i in n]
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], kinds)

    def merge(self, text: str) -> list[str]:
        """The merge loop itself: the adjacent pair whose union has the best score is merged, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Encoder:
    def __init__(self, model: Pieces) -> None:
        self.model = model
        self.seek = ahocorasick.Automaton()
        for p in model.whole:
            self.seek.add_word(p, len(p))
        self.seek.make_automaton()
        self.known = {p for p in model.id if len(p) == 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, np.ndarray] = {}
        raw = [p.replace(MARK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.model.merge(a + b) == [a, b]
        return found

    def run(self, text: str) -> list[str]:
        """Pieces of a run of known characters."""
        n = len(text)
        ends: list[list[int]] = [[] for _ in range(n)]  # where the pieces that begin here end, shortest first
        for last, size in self.seek.iter(text):
            ends[last - size + 1].append(last + 1)
        failed, pos, out, back = bytearray(n // 8 + 1), 0, [], []
        pick = len(ends[0]) - 1
        while pos < n:
            while pick >= 0:
                end = ends[pos][pick]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], text[pos:end])):
                    break
                pick -= 1
            if pick >= 0:
                out.append(text[pos:end])
                back.append((pos, pick))
                pos = end
                pick = len(ends[pos]) - 1 if pos < n else 0
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos, pick = back.pop()
                out.pop()
        return out

    def word(self, word: str) -> np.ndarray:
        """Ids of one segment; characters that aren't pieces become their bytes."""
        found = self.cache.get(word)
        if found is not None:
            return found
        ids, byte, begin = [], self.model.byte, 0
        to_id = self.model.id
        for k, c in enumerate(word):
            if c not in self.known:
                if k > begin:
                    ids += [to_id[p] for p in self.run(word[begin:k])]
                raw = c.encode()
                ids += [byte[x] for x in raw] if byte else [self.model.unknown]
                begin = k + 1
        if len(word) > begin:
            ids += [to_id[p] for p in self.run(word[begin:])]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) < 64:
            self.cache[word] = (got := np.array(ids, np.int32))
            return got
        return np.array(ids, np.int32)

    def text(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.concatenate([self.word(s) for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all rows; null and empty texts have no ids."""
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        # runs of white space or marks in the text make segments that are more than one word: row by row
        odd = pc.match_substring_regex(texts, rf"^ | $|  |{MARK}").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(plain, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(lists.flatten())
        own = [self.word(MARK + w) if w else np.zeros(0, np.int32) for w in words.dictionary.to_pylist()]
        size = np.array([len(x) for x in own], np.int64)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, upto = _gather(np.concatenate([*own, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(size)]), codes)
        offs = upto[at]
        if odd.any():
            rows = [self.text(texts[k].as_py()) if odd[k] else ids[offs[k] : offs[k + 1]] for k in range(n)]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            ids = np.concatenate([*rows, np.zeros(0, np.int32)])
        return ids, offs

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the rows' texts: the pieces' characters, without the first word's mark."""
        data, upto = _gather(self.piece_bytes, self.piece_at, ids.astype(np.int64))
        begin, end = upto[offs[:-1]], upto[offs[1:]]
        first = (end > begin) & (data[np.minimum(begin, max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(begin), bool)
        keep = np.ones(len(data), bool)
        keep[begin[first]] = False
        return data[keep], np.concatenate([[0], np.cumsum(end - begin - first)]).astype(np.int64)


def _gather(values: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``values[at[c]:at[c+1]]`` of all codes one after another, and where each begins (and the last ends)."""
    size = at[codes + 1] - at[codes]
    upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return values[np.repeat(at[codes] - upto[:-1], size) + np.arange(upto[-1])], upto


def _with(docs: DataFrame, column: str, kind: str, cols: dict[str, str], f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    udf = F.arrow_udf(f, kind).asNondeterministic()  # so that a filter doesn't run it twice
    made = packed(docs).select("row", udf(of_row(column)).alias("new"))
    return unpacked(made, docs.columns, {name: F.col("new").getField(field) for name, field in cols.items()})


def encode(docs: DataFrame, model: Pieces, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` (array<int>) and ``decodes`` (the ids give the text again, byte by byte).

    They replace columns so named; columns of any other name stay. Null and empty texts have no ids; a null text doesn't
    decode (null). Rows are encoded one by one, so ties, repeated rows and null ids change nothing; texts are encoded
    whole, however long. ``decodes`` is false only
    for texts that hold the mark character itself. An empty table gives an empty table.
    """
    held: list[Encoder] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(model))
        data, offs = flat(texts)
        parts = []
        for i, j in slices(offs, SLICE):
            part = texts.slice(i, j - i)
            ids, at = held[0].batch(part)
            back, upto = held[0].decode(ids, at)
            size = offs[i + 1 : j + 1] - offs[i:j]
            same = np.diff(upto) == size
            if same.all():
                bad = np.flatnonzero(back != data[offs[i] : offs[j]])
                same[np.searchsorted(upto, bad, side="right") - 1] = False
            else:
                same = np.array([s and bool((back[upto[k] : upto[k + 1]] == data[offs[i + k] : offs[i + k + 1]]).all()) for k, s in enumerate(same)], bool)
            lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids))
            parts.append(pa.StructArray.from_arrays([lists, pc.if_else(part.is_null(), None, pa.array(same))], ["ids", "same"]))
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())])
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    return _with(docs, text_col, "struct<ids: array<int>, same: boolean>", {"piece_ids": "ids", "decodes": "same"}, run)


def decode(rows: DataFrame, model: Pieces, *, ids_col: str = "piece_ids") -> DataFrame:
    """``rows`` with ``decoded`` (string; replaces a column so named). A null list and a list with a null or an id that is no piece give null; no ids give an empty text; bytes that aren't UTF-8 are replaced."""
    held: list[Encoder] = []

    def run(lists: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(model))
        out = []
        for ids in lists.to_pylist():
            if ids is None or any(i is None or not 0 <= i < len(model.pieces) for i in ids):
                out.append(None)
            else:
                out.append(held[0].decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"])

    return _with(rows, ids_col, "struct<text: string>", {"decoded": "text"}, run)


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Pieces.load(model)).drop("text")
