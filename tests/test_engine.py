import math
import random
import time

import pytest
from pyspark.sql import functions as F

from postingflow.__main__ import main
from postingflow.functions import analysis
from postingflow.operators import ranges, score
from postingflow.operators import search as s
from postingflow.operators.index import build_index, load
from postingflow.plans.query import Adjacent, And, Near, Not, Or, Term, leaves, parse_query, parse_syntax, required
from postingflow.queries import show
from postingflow.sources.documents import from_tsv, join_parts
from postingflow.streaming.tokens import append_documents, load_stream

from .model import evaluate, positions

FIVE = ["This is the first document.", "This is the second document.", "This is the third document. This is the second sentence in the third.", "Fourth document", "Hello World!"]
TWO = ["apple orange orange banana", "banana orange strawberry strawberry grape"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    build_index(table(spark, FIVE)).save(path := f"file://{tmp_path_factory.mktemp('five')}")
    return load(spark, path)


def found(index, text):
    expr = parse_query(index, text)
    rows = ranges.text_ranges(index, s.perform_search(index, expr)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.hit_index)):
        out.setdefault(r.doc_id, []).append((r.term_pos, r.term_len, r.position, r.length))
    return show(expr), out


def test_tokens_and_statistics(five):
    got = {}
    for r in five.tokens().collect():
        got.setdefault(r.doc_id, []).append((r.term_pos, r.term))
    assert [t for _, t in sorted(got[2])] == "this is the third document this is the second sentence in the third".split()
    assert five.document_count() == 5 and five.term_count("the") == 5 and five.df("the") == 3
    assert five.term_count("the", 2) == 3 and five.term_count("the", 4) == 0
    assert five.document_term_count(2) == 13 and five.average_document_term_count() == 27 / 5
    assert five.term_exists("hello") and not five.term_exists("Hello")
    for call in (lambda: five.term_count("zzz"), lambda: five.term_count("zzz", 1), lambda: five.document_term_count(9)):
        with pytest.raises(KeyError):
            call()


def test_golden_searches(five):
    kind, got = found(five, " The ")
    assert kind == "the" and len(got) == 3 and got[0] == [(2, 1, 8, 3)] and got[2] == [(2, 1, 8, 3), (7, 1, 36, 3), (11, 1, 59, 3)]
    assert found(five, " second ")[1] == {1: [(3, 1, 12, 6)], 2: [(8, 1, 40, 6)]}
    kind, got = found(five, " the second third ")
    assert kind == "And[the,second,third]" and list(got) == [2] and len(got[2]) == 6
    assert got[2][1] == (3, 1, 12, 5) and got[2][3] == (8, 1, 40, 6) and got[2][5] == (12, 1, 63, 5)
    kind, got = found(five, " third | HELLO | second ")
    assert kind == "Or[third,hello,second]"
    assert got == {1: [(3, 1, 12, 6)], 2: [(3, 1, 12, 5), (8, 1, 40, 6), (12, 1, 63, 5)], 4: [(0, 1, 0, 5)]}
    kind, got = found(five, ' "is the" ')
    assert kind == "Adjacent[is,the]" and got == {0: [(1, 2, 5, 6)], 1: [(1, 2, 5, 6)], 2: [(1, 2, 5, 6), (6, 2, 33, 6)]}
    assert found(five, ' "the second sentence" ')[1] == {2: [(7, 3, 36, 19)]}
    kind, got = found(five, " second ~ document ")
    assert kind == "Near[second,document]" and got == {1: [(3, 1, 12, 6), (4, 1, 19, 8)], 2: [(4, 1, 18, 8), (8, 1, 40, 6)]}
    assert found(five, ' sentence ~ "is the" ')[1] == {2: [(6, 2, 33, 6), (9, 1, 47, 8)]}


def test_parsing(five):
    want = {"the ~ second third | hello": "Or[And[Near[the,second],third],hello]", '"the"': "the", "(the)": "the", "the the": "And[the,the]", "((the second) third)": "And[And[the,second],third]", "the|second": "Or[the,second]", "\tthe\t": "the"}
    for text, tree in want.items():
        assert show(parse_query(five, text)) == tree
    for text in ["nothing", "third | zzz", "the zzz", '"the zzz"', "third |", "third ~", '"the', "the\nsecond", "", "  ", "(the", "the)", "| the", '""', "()", "the-first", "the1", "où", 'the "second', "the;"]:
        assert parse_query(five, text) is None, text
    assert list(leaves(parse_syntax('a b | a ~ "b c"'))) == ["a", "b", "a", "b", "c"]
    assert parse_syntax("the second ~ (a | b)") == And(Term("the"), Near(Term("second"), Or(Term("a"), Term("b"))))
    with pytest.raises(ValueError):
        And()


def test_frequencies(spark):
    index = build_index(table(spark, TWO))
    got = {(r.term, r.doc_id): r.tf for r in index.term_frequency().collect()}
    want = {("apple", 0): 0.25, ("orange", 0): 0.5, ("orange", 1): 0.2, ("banana", 0): 0.25, ("banana", 1): 0.2, ("strawberry", 1): 0.4, ("grape", 1): 0.2}
    assert got == want
    assert {r.term: r.df for r in index.terms.collect()} == {"apple": 1, "orange": 2, "banana": 2, "strawberry": 1, "grape": 1}
    assert index.tf("apple", 1) == 0.0 and index.tf("orange", 0) == 0.5


def test_readme_example(spark):
    texts = [FIVE[0], FIVE[1], "This is the third document. This is the second sentence in the third document.", "This is not the first document."]
    index = build_index(table(spark, texts))
    _, got = found(index, 'first not | "the second sentence"')
    assert got == {2: [(7, 3, 36, 19)], 3: [(2, 1, 8, 3), (4, 1, 16, 5)]}
    rows = ranges.snippets(ranges.text_ranges(index, s.search(index, '"the second sentence"')), table(spark, texts)).collect()
    assert [r.snippet for r in rows] == ["the second sentence"]


def test_near_by_hand(spark):
    def text(**words):
        n = 1 + max(p for ps in words.values() for p in ps)
        at = {p: w for w, ps in words.items() for p in ps}
        return " ".join(at.get(p, "x") for p in range(n))

    texts = [text(a=[0], b=[1, 4], c=[8]), text(a=[1, 2], b=[5, 6]), text(a=[2, 9]), text(a=[2, 4]), text(a=[6], b=[7], c=[8]), "a a a"]
    index = build_index(table(spark, texts))
    hits = lambda e: {r.doc_id: [h.pos for h in r.hits] for r in s.perform_search(index, e).collect()}
    a, b, c = map(Term, "abc")
    assert 0 not in hits(Near(a, b, c))
    assert hits(Near(a, b))[1] == [1, 5, 2, 6]
    same = hits(Near(a, a))
    assert same[2] == [2, 9] and same[3] == [2, 2, 4]
    assert 4 not in hits(Near(Adjacent(a, b, c), b)) and hits(Near(Adjacent(a, b), b))[4] == [6, 7]
    assert hits(Adjacent(a, a))[5] == [0, 1]
    assert hits(And(a, a))[5] == [0, 0, 1, 1, 2, 2]
    assert hits(And(Adjacent(a, c), a)) == {} and hits(Term("zzz")) == {}
    with pytest.raises(KeyError):
        s.perform_search(index, Or(a, Term("zzz")), strict=True)


def test_random_expressions(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    build = table(spark, texts)
    index = build_index(build)
    held = index.postings.cache()
    index = type(index)(index.forward, held, index.doc_stats, index.terms)
    docs = [positions(t) for t in texts]

    def tree(depth):
        kind = rng.choice([Term, And, Or, Adjacent, Near, Near]) if depth else Term
        if kind is Term:
            return Term(rng.choice("abcde"))
        if kind is Adjacent:
            return Adjacent(*[Term(rng.choice("abcd")) for _ in range(rng.randrange(1, 4))])
        children = [tree(depth - 1) for _ in range(rng.randrange(1, 4))]
        return Near(*children, distance=rng.choice([0, 1, 2, 4])) if kind is Near else kind(*children)

    for _ in range(40):
        e = tree(2)
        got = {r.doc_id: [(h.pos, h.len) for h in r.hits] for r in s.perform_search(index, e).collect()}
        want = {k: h for k, d in enumerate(docs) if (h := evaluate(e, d))}
        assert got == want, show(e)
    e = Not(Or(Term("a"), Term("b")), Near(Term("c"), Term("d")))
    got = {r.doc_id: [(h.pos, h.len) for h in r.hits] for r in s.perform_search(index, e).collect()}
    assert got == {k: h for k, d in enumerate(docs) if (h := evaluate(e, d))}
    held.unpersist()


def test_scores(spark):
    index = build_index(table(spark, [*TWO, "123 !", None, ""]))
    assert index.document_count() == 5 and index.document_term_count(2) == 0 == index.document_term_count(3)
    e = parse_query(index, "orange | apple | apple")
    result = s.perform_search(index, e)
    by = lambda df: {r.doc_id: r.score for r in df.collect()}
    assert by(score.term_count_score(index, e, result)) == {0: 4.0, 1: 1.0}
    idf = {t: math.log2(5.001 / (n + 0.001)) for t, n in (("orange", 2), ("apple", 1))}
    got = by(score.tf_idf_score(index, e, result))
    assert abs(got[0] - (0.5 * idf["orange"] + 2 * 0.25 * idf["apple"])) < 1e-12 and abs(got[1] - 0.2 * idf["orange"]) < 1e-12
    got = by(score.bm25_score(index, e, result, k1=1.5, b=0.5))
    part = lambda n, tf, dl: math.log2((5 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * dl / (9 / 5)))
    assert abs(got[0] - part(2, 0.5, 4) - 2 * part(1, 0.25, 4)) < 1e-12 and abs(got[1] - part(2, 0.2, 5)) < 1e-12
    assert [r.doc_id for r in score.top(score.bm25_score(index, e, result), 1).collect()] == [0]


def test_result_tables(five):
    result = s.search(five, "the")
    assert {r.doc_id: r.i for r in s.numbered(result).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.doc_id: r.i for r in s.numbered(result, rows_per_task=1).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.doc_id: r.search_hit_count for r in s.hit_counts(result).collect()} == {0: 1, 1: 1, 2: 3}
    assert {r.doc_id: r.is_term_position for r in s.term_positions(result, 7).collect()} == {0: False, 1: False, 2: True}
    assert s.search(five, "the | zzz").count() == 0 and s.search(five, "the | zzz").columns == ["doc_id", "hits"]
    assert s.without(five, Term("the"), Term("third")).count() == 2
    assert s.numbered(s.search(five, "")).count() == 0


def test_bytes_and_normalizers(spark):
    docs = table(spark, ["où été", "a1b_c-d'e", "ÉCOLE Straße", "日本 語", "", None, "é" * 5 + " \U0001f600x"])
    index = build_index(docs)
    got = {}
    for r in index.tokens().orderBy("doc_id", "term_pos").collect():
        got.setdefault(r.doc_id, []).append((r.term, r.position, r.length))
    assert got == {0: [("où", 0, 3), ("été", 4, 5)], 1: [("a", 0, 1), ("b", 2, 1), ("c", 4, 1), ("d", 6, 1), ("e", 8, 1)], 2: [("école", 0, 6), ("straße", 7, 7)], 3: [("日本", 0, 6), ("語", 7, 3)], 6: [("ééééé", 0, 10), ("x", 15, 1)]}
    terms = lambda a: {r.term for r in build_index(docs, analyzer=a).terms.collect()}
    assert "ÉCOLE" in terms(analysis.RAW) and "École" in terms(analysis.ASCII_LOWERCASE) and "école" in terms(analysis.LOWERCASE)
    words = analysis.Analyzer(tokens=lambda t: F.split(t, " "), ranges=lambda t: F.struct(F.transform(F.split(t, " "), lambda w: F.lit(0).cast("long")).alias("starts"), F.transform(F.split(t, " "), lambda w: F.octet_length(w).cast("long")).alias("lengths")))
    assert build_index(table(spark, ["r2d2 c-3po"]), analyzer=words).term_exists("c-3po")


def test_ids(spark):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    empty = build_index(table(spark, ["x"]).limit(0))
    assert empty.document_count() == 0 and empty.average_document_term_count() is None and s.search(empty, "x").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('1\tGen\t1\t1\tIn "the\n2\tGen\t1\t2\t\\back" slash\nbad line\n\n')
    got = [(r.doc_id, r.text) for r in from_tsv(spark, f"{tmp_path}/t.tsv", text_field=4).orderBy("doc_id").collect()]
    assert got == [(None, None), (1, 'In "the'), (2, '\\back" slash')]
    verses = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, "c")], "book int, chapter int, verse int, text string")
    assert {(r.book, r.chapter): r.text for r in join_parts(verses, ["book", "chapter"], "verse").collect()} == {(1, 1): "a\\nb", (1, 2): "c"}
    index = build_index(spark.createDataFrame([(1, "x\\nAnd y")], "doc_id long, text string"))
    assert {r.term for r in index.terms.collect()} == {"x", "nand", "y"}


def test_stream(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/index"
    for k in range(2):
        spark.createDataFrame([(k, FIVE[k])], "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        append_documents(stream, path, f"{tmp_path}/checkpoint").awaitTermination()
    index = load_stream(spark, path)
    assert index.document_count() == 2 and index.df("document") == 2 and index.df("second") == 1
    assert {r.doc_id for r in s.search(index, '"is the"').collect()} == {0, 1}


def test_ids_of_other_batches(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/index"
    for k in range(2):
        spark.createDataFrame([(7, FIVE[k])], "doc_id long, text string").write.mode("append").parquet(source)
        query = append_documents(spark.readStream.schema("doc_id long, text string").parquet(source), path, f"{tmp_path}/checkpoint")
        if k:
            with pytest.raises(Exception, match="document id 7 is repeated"):
                query.awaitTermination()
        else:
            query.awaitTermination()


def test_command_line(spark, tmp_path, capsys):
    table(spark, FIVE).write.parquet(f"{tmp_path}/docs")
    assert main(["index", f"{tmp_path}/docs", f"{tmp_path}/index"]) == 0
    assert main(["search", f"{tmp_path}/index", '"is the"']) == 0
    assert capsys.readouterr().out.count("|") == 7 * 5
    assert main(["search"]) == 2


def test_long_documents(spark):
    """Phrase and nearness in texts of 200,000 words take time in proportion to their length."""
    n = 100_000
    texts = ["a b " * n, "a x x x x x b " * (n // 4), "a " * n + "b " * n]
    index = build_index(table(spark, texts))
    begin = time.time()
    assert {r.doc_id: len(r.hits) for r in s.perform_search(index, Adjacent(Term("a"), Term("b"))).collect()} == {0: n, 2: 1}
    got = {r.doc_id: len(r.hits) for r in s.perform_search(index, Near(Term("a"), Term("b"))).collect()}
    assert got == {k: len(h) for k, t in enumerate(texts) if (h := evaluate(Near(Term("a"), Term("b")), positions(t)))}
    nested = And(Near(Term("a"), Term("b")), Adjacent(Or(Term("a"), Term("zzz")), Term("b")))
    got = {r.doc_id: [(h.pos, h.len) for h in r.hits] for r in s.perform_search(index, nested).collect()}
    assert got == {k: h for k, t in enumerate(texts) if (h := evaluate(nested, positions(t)))}
    assert time.time() - begin < 60


def test_rare_word_prunes(five):
    expr = parse_query(five, "the sentence")
    assert required(expr) == {"the", "sentence"} and required(Or(Term("a"), And(Term("a"), Term("b")))) == {"a"} == required(Not(Term("a"), Term("b")))
    plan = s.perform_search(five, expr)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan
    assert [r.doc_id for r in s.perform_search(five, expr).collect()] == [2]
    assert five.known["sentence"] == 1 and five.dfs(["zzz", "the"]) == {"zzz": 0, "the": 3}


def test_numbers_of_far_ids(spark):
    ids = [-(2**62), *range(40), 2**62, 2**62 + 1]
    result = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for rows in (1, 7, 1000):
        assert {r.doc_id: r.i for r in s.numbered(result, rows_per_task=rows).collect()} == {i: k for k, i in enumerate(ids)}


def test_deep_queries():
    assert parse_syntax("(" * 150 + "a" + ")" * 150) == Term("a") and parse_syntax("(" * 3000 + "a" + ")" * 3000) is None


def test_ranged_index(spark, tmp_path):
    docs = table(spark, FIVE).orderBy(F.rand(1))
    build_index(docs, ranged=True).save(path := f"file://{tmp_path}/index")
    index = load(spark, path)
    assert found(index, '"is the"')[1] == {0: [(1, 2, 5, 6)], 1: [(1, 2, 5, 6)], 2: [(1, 2, 5, 6), (6, 2, 33, 6)]}
    plan = ranges.text_ranges(index, s.search(index, "sentence"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,2)" in plan or "In(doc_id" in plan


def test_saving_analyses_once(spark, tmp_path):
    """Texts are read for the forward table only; everything else is read from that."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        calls.add(1)
        return (text or "").split()

    none = lambda t: F.struct(F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("lengths"))
    once = analysis.Analyzer(tokens=words, ranges=none, normalize=analysis.identity)
    build_index(table(spark, FIVE), analyzer=once).save(f"file://{tmp_path}/index")
    assert calls.value == len(FIVE)


def test_plan_is_one_shuffle(five):
    plan = s.perform_search(five, And(Term("the"), Or(Term("second"), Near(Term("first"), Term("document")))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1 + plan.count("BroadcastExchange") and "PushedFilters: [In(term" in plan
    lazy = s.perform_search(build_index(five.forward.select("doc_id", F.array_join("terms", " ").alias("text"))), Near(Term("the"), Term("document")))
    plan = lazy._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
