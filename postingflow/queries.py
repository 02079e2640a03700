"""The engine's own operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis
from .operators import ranges, score
from .operators.index import Index, build_index, load
from .operators.search import hit_counts, hits, numbered, perform_search, search, term_positions
from .plans.query import Adjacent, And, Near, Not, Or, Term, leaves, parse_query, parse_syntax
from .sources.documents import chapters, from_parquet, from_tsv, join_parts
from .storage import shared_folder
from .streaming.tokens import append_documents, load_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_parquet(spark, f"{sf_dir}/documents.parquet")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The driver's ids are known to be unique; the check of that is tested by itself."""
    return build_index(_documents(spark, sf_dir), check=False)


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- SQL: tokens of all documents, then what the queries ask of them
def _occ(table: str = "documents", doc: str = "doc_id", text: str = "text") -> str:
    return f"""t as (select {doc} as doc_id, regexp_extract_all({text}, '\\p{{L}}+') as toks, regexp_split_to_array({text}, '\\p{{L}}+') as gaps from {table}),
u as (select doc_id, unnest(toks) as raw, unnest(gaps[:len(toks)]) as gap, unnest(range(len(toks))) as term_pos from t),
occ as (select doc_id, cast(term_pos as bigint) as term_pos, lower(raw) as term, cast(strlen(raw) as bigint) as length,
  cast(sum(strlen(gap) + strlen(raw)) over (partition by doc_id order by term_pos) - strlen(raw) as bigint) as position from u),
dl as (select doc_id, cast(len(toks) as bigint) as term_count from t)"""


_WITH = "with recursive " + _occ()


def _phrase(name: str, *words: str) -> str:
    joins = " ".join(f"join occ o{k} on o{k}.doc_id = o0.doc_id and o{k}.term_pos = o0.term_pos + {k} and o{k}.term = '{w}'" for k, w in enumerate(words) if k)
    return f"{name} as (select o0.doc_id, o0.term_pos, {len(words)} as term_len from occ o0 {joins} where o0.term = '{words[0]}')"


def _word(name: str, word: str) -> str:
    return f"{name} as (select doc_id, term_pos, 1 as term_len from occ where term = '{word}')"


def _both(name: str, *parts: str) -> str:
    """Hits of all parts in documents that have all, by position and then part."""
    union = " union all ".join(f"select {k} as slot, * from {p}" for k, p in enumerate(parts))
    return f"{name} as (select doc_id, term_pos, term_len, slot from ({union}) where " + " and ".join(f"doc_id in (select doc_id from {p})" for p in parts) + ")"


def _either(name: str, *parts: str) -> str:
    return f"{name} as (" + " union all ".join(f"select doc_id, term_pos, term_len, {k} as slot from {p}" for k, p in enumerate(parts)) + ")"


def _near(name: str, a: str, b: str, distance: int = 4) -> str:
    """The walk of two cursors over two lists that have no position in common."""
    gap = lambda i, j: f"(case when a[{i}] < b[{j}] then b[{j}] - (a[{i}] + la[{i}] - 1) else a[{i}] - (b[{j}] + lb[{j}] - 1) end) between 0 and {distance}"
    return f"""{name}_l as (select doc_id, a, la, b, lb from
  (select doc_id, list(term_pos order by term_pos) as a, list(term_len order by term_pos) as la from {a} group by doc_id) join
  (select doc_id, list(term_pos order by term_pos) as b, list(term_len order by term_pos) as lb from {b} group by doc_id) using (doc_id)),
{name}_s(doc_id, i, j, step, near) as (
  select doc_id, 1, 1, 1, {gap("1", "1")} from {name}_l
  union all
  select s.doc_id, s.i + d.di, s.j + d.dj, s.step + 1, {gap("s.i + d.di", "s.j + d.dj")}
  from {name}_s s join {name}_l using (doc_id),
       lateral (select case when s.near or a[s.i] < b[s.j] then 1 else 0 end as di, case when s.near or a[s.i] > b[s.j] then 1 else 0 end as dj) d
  where s.i + d.di <= len(a) and s.j + d.dj <= len(b)),
{name}_m as (select doc_id, step, unnest([least(a[i], b[j]), greatest(a[i], b[j])]) as term_pos,
  unnest([case when a[i] < b[j] then la[i] else lb[j] end, case when a[i] < b[j] then lb[j] else la[i] end]) as term_len, unnest([0, 1]) as k
  from {name}_s join {name}_l using (doc_id) where near),
{name} as (select doc_id, term_pos, term_len, step * 2 + k as slot from {name}_m)"""


def _hits(name: str, order: str) -> str:
    return f"select doc_id, cast(row_number() over (partition by doc_id order by {order}) - 1 as bigint) as hit_index, cast(term_pos as bigint) as term_pos, cast(term_len as bigint) as term_len from {name}"


# ---- analysis and index
@_query("tokenize", _WITH + " select doc_id, term_pos, term, position, length from occ")
def tokenize(spark, sf_dir):
    return _index(spark, sf_dir).tokens()


@_query("tokenize_ascii_lowercase", _WITH + ", d as (select distinct raw from u) select raw, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d")
def tokenize_ascii_lowercase(spark, sf_dir):
    raw = _documents(spark, sf_dir).select(F.explode(analysis.letter_runs(F.col("text"))).alias("raw")).distinct()
    return raw.select("raw", analysis.ascii_lowercase(F.col("raw")).alias("term"))


@_query("code_points", "select doc_id, cast(length(text) as bigint) as code_points, cast(strlen(text) as bigint) as utf8_bytes from documents")
def code_points(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", analysis.code_points(text).cast("long").alias("code_points"), analysis.utf8_bytes(text).cast("long").alias("utf8_bytes"))


@_query("utf8_round_trip", "select doc_id, md5(text) as encoded, md5(text) as decoded, cast(strlen(text) as bigint) as utf8_bytes from documents")
def utf8_round_trip(spark, sf_dir):
    """Digests of the text's bytes, and of those of the text that they are decoded to."""
    data = F.encode("text", "UTF-8")
    return _documents(spark, sf_dir).select("doc_id", F.md5(data).alias("encoded"), F.md5(F.encode(F.decode(data, "UTF-8"), "UTF-8")).alias("decoded"), F.length(data).cast("long").alias("utf8_bytes"))


_CUT = 101  # bytes; cuts some characters in two


@_query(
    "valid_utf8",
    f"""with c as (select doc_id, unnest(string_split(left(text, {_CUT}), '')) as ch, unnest(range(length(left(text, {_CUT})))) as i from documents where text <> ''),
u as (select *, sum(strlen(ch)) over (partition by doc_id order by i) as upto from c)
select doc_id, coalesce(string_agg(ch, '' order by i) filter (upto <= {_CUT}), '') || case when bool_or(upto > {_CUT} and upto - strlen(ch) < {_CUT}) then chr(65533) else '' end as text from u group by doc_id
union all select doc_id, text from documents where text = ''""",
)
def valid_utf8(spark, sf_dir):
    """The first bytes of each text, in which the last character may be incomplete."""
    data = F.substring(F.encode("text", "UTF-8"), 1, _CUT)
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", analysis.valid_utf8(data).alias("text"))


@_query("utf16", "select doc_id, cast(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]')) as bigint) as utf16_units, md5(text) as decoded from documents")
def utf16(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", analysis.utf16_units(text).alias("utf16_units"), F.md5(F.encode(analysis.from_utf16(analysis.utf16(text)), "UTF-8")).alias("decoded"))


@_query("doc_stats", _WITH + " select doc_id, term_count from dl")
def doc_stats(spark, sf_dir):
    return _index(spark, sf_dir).doc_stats


@_query("corpus_stats", _WITH + " select count(*) as document_count, round(avg(term_count), 6) as average_document_term_count from dl")
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).corpus_stats().withColumn("average_document_term_count", F.round("average_document_term_count", 6))


@_query("term_stats", _WITH + " select term, count(distinct doc_id) as df, count(*) as term_count from occ group by term")
def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms


@_query("postings", _WITH + " select term, doc_id, string_agg(cast(term_pos as varchar), ',' order by term_pos) as positions from occ group by term, doc_id")
def postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.withColumn("positions", F.array_join("positions", ","))


@_query("term_frequency", _WITH + " select term, doc_id, count(*) as term_count, round(count(*) / any_value(dl.term_count), 9) as tf from occ join dl using (doc_id) group by term, doc_id")
def term_frequency(spark, sf_dir):
    return _index(spark, sf_dir).term_frequency().withColumn("tf", F.round("tf", 9))


@_query("term_exists", _WITH + " select w as term, w in (select term from occ) as found from (values ('the'), ('that'), ('zzz'), ('The'), ('der'), ('')) as v(w)")
def term_exists(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("the", "that", "zzz", "The", "der", "")], "term string")
    there = _index(spark, sf_dir).terms.select("term", F.lit(True).alias("found"))
    return words.join(there, "term", "left").select("term", F.coalesce("found", F.lit(False)).alias("found"))


@_query("saved_index", _WITH + " select doc_id, count(*) as search_hit_count from occ where term = 'that' group by doc_id")
def saved_index(spark, sf_dir):
    """The same search on an index that was saved and loaded."""
    path = shared_folder(spark, "index")
    _index(spark, sf_dir).save(path)
    return hit_counts(search(load(spark, path), "that"))


# ---- query language
PARSED = ["the", " The ", "the that", "the | that", '"of the"', "the ~ that", "(the)", '"the"', "the ~ that on | of", "a | ", "a ~", '"of', "of\nthe", "", " \t", "zzz", "the zzz", "the | zzz", '"the zzz"', "(the", "the)", '"(the)"', "a|the", "über", "the-that", "((the) (that)) | of"]


def show(expr) -> str | None:
    if expr is None:
        return None
    return expr.term if isinstance(expr, Term) else f"{type(expr).__name__}[{','.join(map(show, expr.children))}]"


_SHOWN = ["the", "the", "And[the,that]", "Or[the,that]", "Adjacent[of,the]", "Near[the,that]", "the", "the", "Or[And[Near[the,that],on],of]", None, None, None, None, None, None, None, None, None, None, None, None, None, "Or[a,the]", None, None, "Or[And[the,that],of]"]


@_query("parse_query", "select cast(n as bigint) as n, shown from (values " + ", ".join(f"({k}, {repr(s) if s else 'null'})" for k, s in enumerate(_SHOWN)) + ") as v(n, shown)")
def parse_queries(spark, sf_dir):
    """Trees of many queries; their words are looked up in one job."""
    index = _index(spark, sf_dir)
    trees = [parse_syntax(q) for q in PARSED]
    there = index.existing(w for t in trees if t for w in leaves(t))
    rows = [(n, show(t) if t and set(leaves(t)) <= there else None) for n, t in enumerate(trees)]
    return spark.createDataFrame(rows, "n long, shown string")


@_query("enumerate_terms", "select cast(n as bigint) as n, term from (values (0, 'the'), (1, 'that'), (2, 'the'), (3, 'of'), (4, 'the')) as v(n, term)")
def enumerate_terms(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(leaves(parse_syntax('the that | the ~ "of the"')))), "n long, term string")


# ---- search
def _search(name: str, text: str, ctes: str, order: str = "term_pos, slot", last: str = "r", sql: str | None = None):
    @_query(name, sql or f"{_WITH}, {ctes} {_hits(last, order)}")
    def run(spark, sf_dir):
        return hits(search(_index(spark, sf_dir), text))

    return run


_search("search_term", " The ", _word("r", "the"), "term_pos")
_search("search_and", "the that", ", ".join([_word("a", "the"), _word("b", "that"), _both("r", "a", "b")]))
_search("search_and_repeated", "that that", ", ".join([_word("a", "that"), _both("r", "a", "a")]))
_search("search_or", "the | that", ", ".join([_word("a", "the"), _word("b", "that"), _either("r", "a", "b")]))
_search("search_or_three", "the | THAT | der", ", ".join([_word("a", "the"), _word("b", "that"), _word("c", "der"), _either("r", "a", "b", "c")]))
_search("search_phrase2", '"of the"', _phrase("r", "of", "the"), "term_pos")
_search("search_phrase3", '"on the it"', _phrase("r", "on", "the", "it"), "term_pos")
_search("search_phrase_repeated", '"the the"', _phrase("r", "the", "the"), "term_pos")
_search("search_near_hits", "the ~ that", ", ".join([_word("a", "the"), _word("b", "that"), _near("r", "a", "b")]), "slot")
_search("search_near_phrase", 'a ~ "of the"', ", ".join([_word("a", "a"), _phrase("b", "of", "the"), _near("r", "a", "b")]), "slot")
_search("search_nested", '("of the" | that) on', ", ".join([_phrase("a", "of", "the"), _word("b", "that"), _either("o", "a", "b"), "p as (select doc_id, term_pos, term_len from o)", _word("c", "on"), _both("r", "p", "c")]))
_search("search_precedence", "the ~ that on | der", ", ".join([_word("a", "the"), _word("b", "that"), _near("n", "a", "b"), _word("c", "on"), "p as (select doc_id, term_pos, term_len, max(term_pos) over (partition by doc_id order by slot) as key, slot as s from n)", "q as (select doc_id, term_pos, term_len, term_pos as key, 0 as s from c)", "x as (select 0 as slot, * from p union all select 1, * from q)", "y as (select * from x where doc_id in (select doc_id from p) and doc_id in (select doc_id from q))", _word("e", "der"), "yy as (select doc_id, term_pos, term_len, row_number() over (partition by doc_id order by key, slot, s) as s from y)", "yk as (select *, max(term_pos) over (partition by doc_id order by s) as key from yy)", "r as (select doc_id, term_pos, term_len, key, 0 as slot, s from yk union all select doc_id, term_pos, term_len, term_pos, 1, term_pos from e)"]), "key, slot, s")
_NONE = "select doc_id, doc_id as hit_index, doc_id as term_pos, doc_id as term_len from documents where false"
_search("unknown_term", "the | zzz", "", sql=_NONE)
_search("empty_query", "  ", "", sql=_NONE)
_search("dangling_operator", "the |", "", sql=_NONE)


@_query("search_near_docs", _WITH + ", p as (select doc_id, term_pos, term from occ where term in ('the', 'that')) select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.term = 'the' and b.term = 'that' and abs(a.term_pos - b.term_pos) <= 4")
def search_near_docs(spark, sf_dir):
    return search(_index(spark, sf_dir), "the ~ that").select("doc_id")


@_query("search_near_distance", f"{_WITH}, {_word('a', 'the')}, {_word('b', 'that')}, {_near('r', 'a', 'b', 1)} {_hits('r', 'slot')}")
def search_near_distance(spark, sf_dir):
    return hits(perform_search(_index(spark, sf_dir), Near(Term("the"), Term("that"), distance=1)))


def _near3(name: str, a: str, b: str, c: str, distance: int = 4) -> str:
    """The walk of three cursors over lists that have no position in common."""
    lists = ", ".join(f"{x}, l{x}" for x in "abc")
    listed = lambda x, t: f"(select doc_id, list(term_pos order by term_pos) as {x}, list(term_len order by term_pos) as l{x} from {t} group by doc_id)"
    heads = lambda *at: "list_sort([" + ", ".join(f"{{'p': {x}[{i}], 'l': l{x}[{i}], 's': {n}}}" for n, (x, i) in enumerate(zip("abc", at))) + "])"
    near = " and ".join(f"h[{k + 1}].p - (h[{k}].p + h[{k}].l - 1) between 0 and {distance}" for k in (1, 2))
    moved = ", ".join(f"{i} + case when ({near}) or h[1].s = {n} then 1 else 0 end as {i}" for n, i in enumerate("ijk"))
    return f"""{name}_l as (select doc_id, {lists} from {listed("a", a)} join {listed("b", b)} using (doc_id) join {listed("c", c)} using (doc_id)),
{name}_s(doc_id, i, j, k, step, h) as (
  select doc_id, 1, 1, 1, 1, {heads(1, 1, 1)} from {name}_l
  union all
  select x.doc_id, x.i, x.j, x.k, x.step + 1, {heads("x.i", "x.j", "x.k")}
  from (select doc_id, step, {moved} from {name}_s) x join {name}_l using (doc_id)
  where x.i <= len(a) and x.j <= len(b) and x.k <= len(c)),
{name} as (select doc_id, unnest(h).p as term_pos, unnest(h).l as term_len, step * 3 + unnest([0, 1, 2]) as slot from {name}_s where {near})"""


_search("search_near_three", "the ~ that ~ of", ", ".join([_word("a", "the"), _word("b", "that"), _word("c", "of"), _near3("r", "a", "b", "c")]), "slot")


@_query("search_non_ascii", f"{_WITH}, {_word('a', 'für')}, {_word('b', 'über')}, {_either('r', 'a', 'b')} {_hits('r', 'term_pos, slot')}")
def search_non_ascii(spark, sf_dir):
    """Terms that the query language can't name."""
    return hits(perform_search(_index(spark, sf_dir), Or(Term("für"), Term("über"))))


@_query("search_not", f"{_WITH}, {_word('a', 'the')} {_hits('(select * from a where doc_id not in (select doc_id from occ where term = ' + chr(39) + 'that' + chr(39) + '))', 'term_pos')}")
def search_not(spark, sf_dir):
    return hits(perform_search(_index(spark, sf_dir), Not(Term("the"), Term("that"))))


@_query("document_ids", _WITH + " select doc_id, cast(row_number() over (order by doc_id) - 1 as bigint) as i, count(*) as search_hit_count from occ where term = 'that' group by doc_id")
def document_ids(spark, sf_dir):
    found = search(_index(spark, sf_dir), "that")
    return numbered(found).select("doc_id", "i", F.size("hits").cast("long").alias("search_hit_count"))


@_query("result_size", _WITH + " select count(distinct doc_id) as size from occ where term = 'that'")
def result_size(spark, sf_dir):
    return search(_index(spark, sf_dir), "that").agg(F.count(F.lit(1)).alias("size"))


@_query("is_term_position", _WITH + " select doc_id, bool_or(term_pos = 3) as is_term_position from occ where term = 'the' group by doc_id")
def is_term_position(spark, sf_dir):
    return term_positions(search(_index(spark, sf_dir), "the"), 3)


# ---- ranges
_RANGED = "select p.doc_id, cast(row_number() over (partition by p.doc_id order by p.term_pos) - 1 as bigint) as hit_index, p.term_pos, cast(p.term_len as bigint) as term_len, b.position, e.position + e.length - b.position as length from p join occ b on b.doc_id = p.doc_id and b.term_pos = p.term_pos join occ e on e.doc_id = p.doc_id and e.term_pos = p.term_pos + p.term_len - 1"


@_query("text_ranges", f"{_WITH}, {_phrase('p', 'of', 'the')} {_RANGED}")
def text_ranges(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ranges.text_ranges(index, search(index, '"of the"'))


@_query("text_ranges_non_ascii", f"{_WITH}, {_phrase('p', 'für')} {_RANGED}")
def text_ranges_non_ascii(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ranges.text_ranges(index, perform_search(index, Term("für")))


@_query("snippets", f"{_WITH}, {_phrase('p', 'of', 'the')}, g as ({_RANGED}) select g.*, decode(array_slice(encode(d.text), g.position + 1, g.position + g.length)) as snippet from g join documents d using (doc_id)")
def snippets(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ranges.snippets(ranges.text_ranges(index, search(index, '"of the"')), _documents(spark, sf_dir))


# ---- scores
def _scores(weight: str, result: str, terms: dict[str, int]) -> str:
    times = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""{_WITH}, times(term, times) as (values {times}), n as (select count(*) as n, avg(term_count) as mean from dl),
c as (select doc_id, term, count(*) as k from occ where term in (select term from times) group by doc_id, term), f as (select term, count(*) as df from c group by term),
result as ({result}), s as (select doc_id, sum(times * {weight}) as score from c join times using (term) join f using (term) join dl using (doc_id), n where doc_id in (select doc_id from result) group by doc_id)
select doc_id, round(score, 6) + 0.0 as score from s"""


_TF = "(k / term_count)"
_TFIDF = f"{_TF} * log2((n + 0.001) / (df + 0.001))"
_BM25 = "log2((n - df + 0.5) / (df + 0.5)) * ({tf} * ({k1} + 1)) / ({tf} + {k1} * ({b0} + {b} * term_count / mean))"
_AND = "select doc_id from c group by doc_id having count(distinct term) = 2"


def _score(name: str, text: str, f, sql: str, **kw):
    @_query(name, sql)
    def run(spark, sf_dir):
        index = _index(spark, sf_dir)
        expr = parse_query(index, text)
        scores = f(index, expr, perform_search(index, expr), **kw)
        return scores.withColumn("score", F.round("score", 6) + F.lit(0.0))

    return run


_score("score_term_count", "the that", score.term_count_score, _scores("cast(k as double)", _AND, {"the": 1, "that": 1}))
_score("score_tf_idf", "the that", score.tf_idf_score, _scores(_TFIDF, _AND, {"the": 1, "that": 1}))
_score("score_bm25", "the that", score.bm25_score, _scores(_BM25.format(tf=_TF, k1=1.2, b0=0.25, b=0.75), _AND, {"the": 1, "that": 1}))
_score("score_bm25_params", "the | der", score.bm25_score, _scores(_BM25.format(tf=_TF, k1=2.0, b0=0.5, b=0.5), "select doc_id from c", {"the": 1, "der": 1}), k1=2.0, b=0.5)
_score("score_repeated_leaf", "that that the", score.tf_idf_score, _scores(_TFIDF, _AND, {"that": 2, "the": 1}))
_score("score_phrase", '"of the"', score.bm25_score, _scores(_BM25.format(tf=_TF, k1=1.2, b0=0.25, b=0.75), "select a.doc_id from occ a join occ b on a.doc_id = b.doc_id and a.term_pos + 1 = b.term_pos where a.term = 'of' and b.term = 'the'", {"of": 1, "the": 1}))


@_query("topk_bm25", _scores(_BM25.format(tf=_TF, k1=1.2, b0=0.25, b=0.75), "select doc_id from c", {"that": 1, "der": 1}) + " order by round(score, 6) desc, doc_id limit 10")
def topk_bm25(spark, sf_dir):
    index = _index(spark, sf_dir)
    expr = Or(Term("that"), Term("der"))
    scores = score.bm25_score(index, expr, perform_search(index, expr)).withColumn("score", F.round("score", 6) + F.lit(0.0))
    return score.top(scores, 10)


# ---- sources and streams
@_query("join_parts", "select conv_id, string_agg(text, chr(92) || 'n' order by turn, text) as text from conversations group by conv_id")
def parts(spark, sf_dir):
    return join_parts(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


@_query("chapters", "select cast(printf('%d%02d', conv_id, turn // 2) as bigint) as doc_id, string_agg(text, chr(92) || 'n' order by turn, text) as text from conversations group by conv_id, turn // 2")
def chapters_of_turns(spark, sf_dir):
    """Turns as verses, two to a chapter."""
    verses = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("book"), F.expr("turn div 2").alias("chapter"), F.col("turn").alias("verse"), "text")
    return chapters(verses)


@_query("tab_separated", "select doc_id, regexp_replace(text, '[\t\r\n]', ' ', 'g') as text from documents")
def tab_separated(spark, sf_dir):
    """Documents that were written as lines of tab-separated fields and read again."""
    path = shared_folder(spark, "tsv")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("x"), F.regexp_replace("text", r"[\t\r\n]", " "))
    _documents(spark, sf_dir).select(line).write.text(path)
    return from_tsv(spark, path, text_field=2)


@_query("search_joined_parts", "with recursive g as (select conv_id, string_agg(text, chr(92) || 'n' order by turn, text) as text from conversations group by conv_id), " + _occ("g", "conv_id") + f", {_phrase('r', 'of', 'the')} {_hits('r', 'term_pos')}")
def search_joined_parts(spark, sf_dir):
    return hits(search(build_index(parts(spark, sf_dir), id_col="conv_id", check=False), '"of the"'))


@_query("search_pages", "with recursive " + _occ("pages", "page_id", "html") + f", {_word('a', 'nav')}, {_word('b', 'footer')}, {_both('r', 'a', 'b')} {_hits('r', 'term_pos, slot')}")
def search_pages(spark, sf_dir):
    docs = from_parquet(spark, f"{sf_dir}/pages.parquet", id_col="page_id", text_col="html")
    return hits(perform_search(build_index(docs, check=False), And(Term("nav"), Term("footer"))))


@_query("stream_index", _WITH + " select term, count(distinct doc_id) as df, count(*) as term_count from occ group by term")
def stream_index(spark, sf_dir):
    """The dictionary of documents that came as a stream."""
    path = shared_folder(spark, "stream")
    table = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(table).schema
    # a stream reads a folder: the table's own, or the one that a single file is in
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(table) if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    append_documents(stream.select("doc_id", "text"), f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return load_stream(spark, f"{path}/index").terms


@_query("phrase_of_terms", f"{_WITH}, {_phrase('r', 'of', 'the')} select distinct doc_id from r")
def phrase_of_terms(spark, sf_dir):
    return perform_search(_index(spark, sf_dir), Adjacent(Term("of"), Term("the"))).select("doc_id")
