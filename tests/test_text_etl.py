import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom import sources, streaming
from graphloom.etl import dump, lexicon
from graphloom.graph import rank
from graphloom.operators import skew
from graphloom.plans import etl_queries
from graphloom.plans.data import DUMP_PATHS
from graphloom.text import functions as T
from graphloom.text import tokenizer as K


def one(spark, col, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_normalize(spark):
    got = one(spark, T.normalize(F.col("t")), "l’homme «dit» non…", "un  œuf,\tdeux", "", None, " a")
    assert got == ["l' homme \" dit \" non ... ", "un oeuf , deux", "", None, "a"]


def test_linking_and_answers(spark):
    df = spark.createDataFrame([("et", ["P1"]), ("x", ["Q9", "P3", "P2"]), ("x", ["Q9", "Q1"]), ("Qui", []), ("qui", None), ("x", [])], "f string, ids array<string>")
    assert [r[0] for r in df.select(T.macro(F.col("f"), F.col("ids"))).collect()] == ["AND", "P3", "Q9", "WHQ", "WHQ", None]
    assert one(spark, T.answers_description(F.col("t")), '(list (description "A b") (description C))', "", None) == [["A b", "C"], [], None]
    assert one(spark, T.answers_comma(F.col("t")), " Q1,Q2 ") == [["Q1", "Q2"]]


def test_labels(spark):
    assert one(spark, T.plural(F.col("t")), "city", "bus", "box", "dish", "man", "cat") == ["cities", "buses", "boxes", "dishes", "men", "cats"]
    assert one(spark, T.title(F.col("t")), "o'neil de l'est", None) == ["O'Neil De L'Est", None]
    assert one(spark, T.regular_label(F.col("t")), "a", "a*", "!", "é") == [True, False, False, True]
    assert one(spark, T.number_token(F.col("t")), "3,5x", "x3") == ["<num>", "x3"]


def test_tokens_with_keys_and_compounds(spark):
    trie = K.Trie(["tour Eiffel", "tour", "tour Eif"])
    assert K.tokens_of("la tour Eiffelle", trie, None) == [("la", "word"), ("tour Eiffel", "key"), ("le", "word")]
    rx = re.compile(K.compound_regex())
    assert [f for f, _ in K.tokens_of("aujourd' hui c' est 3 . 14 .", K.Trie([]), rx)][0] == "aujourd'hui"
    compat = re.compile(K.compound_regex(compat=True))
    assert K.tokens_of("aujourd' hui", K.Trie([]), compat) == [("aujourd'", "compound"), ("hui", "word")]
    lex = spark.createDataFrame([("tour Eiffel", "Q243", 3), ("tour Eiffel", "P9", 8), ("Paris", "Q90", 1)], "named_entity string, id string, rank int")
    docs = spark.createDataFrame([(1, "Où est la tour Eiffel ?", "x"), (2, None, "x"), (3, "", "x"), (4, "Paris", "x")], "doc_id long, text string, form string")
    got = [tuple(r) for r in K.link(K.tokenize(docs, "doc_id", "text", lex), lex).select("doc_id", "form", "macro").orderBy("doc_id", "pos").collect()]
    assert got == [(1, "Où", "WHQ"), (1, "est", None), (1, "la", None), (1, "tour Eiffel", "P9"), (1, "?", None), (4, "Paris", "Q90")]
    best = K.longest_prefix(docs, "doc_id", "text", spark.createDataFrame([("P",), ("Par",), ("Où est",), ("",)], "named_entity string"))
    assert sorted(map(tuple, best.collect()))[-1] == (4, "Par")


def test_longest_prefix_at_any_number_of_lengths(spark):
    chars = random.Random(5)
    some = lambda n, most: ["".join(chars.choice("abé") for _ in range(chars.randint(0, most))) for _ in range(n)]
    texts = [*((i, t) for i, t in enumerate(some(1500, 12))), *((1500 + i, "aab" * 30) for i in range(300)), (9000, None), (7, "éabé"), (None, "aab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chains = ["aab" * n for n in range(1, 31)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # parts end between keys and the texts they begin
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in ([*some(150, 5), "b"], [*some(20, 3), "", *chains], [k for k in some(40, 6) if len(k) > 3], []):
            want: dict = {}
            for i, t in texts:
                for k in keys:
                    if t is not None and t.startswith(k) and (i not in want or (len(k), k.encode()) > (len(want[i]), want[i].encode())):
                        want[i] = k
            got = K.longest_prefix(docs, "doc_id", "text", spark.createDataFrame([(k,) for k in [*keys, *keys[:9], None]], "named_entity string")).collect()
            assert len(got) == len(want) and {r[0]: r[1] for r in got} == want
        wide = docs.unionByName(spark.range(300).select((F.col("id") + 20_000).alias("doc_id"), F.concat(F.repeat(F.lit("b"), 100_000), F.col("id").cast("string")).alias("text")))
        got = K.longest_prefix(wide, "doc_id", "text", spark.createDataFrame([("b" * 100_000 + "7",), ("aa",)], "named_entity string"))
        want = {(i, "aa") for i, t in texts if t and t.startswith("aa")} | {(20_000 + i, "b" * 100_000 + "7") for i in range(300) if str(i)[0] == "7"}
        assert {tuple(r) for r in got.collect()} == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)

    def plan(most):
        keys = spark.range(1, most).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("named_entity"))
        return len(K.longest_prefix(docs, "doc_id", "text", keys)._jdf.queryExecution().optimizedPlan().toString())

    assert plan(200) < 2 * plan(3)  # the driver's plan doesn't grow with the lengths that keys have


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"utterance": "a", "targetValue": "Q1"}\n')
    assert K.read_questions(spark, str(tmp_path / "q.jsonl")).first()["utterance"] == "a"
    (tmp_path / "lex.txt").write_text("a b ::: Q1;Q2\nc ::: Q3\na b ::: Q9\n")
    assert sorted(map(tuple, K.read_lexicon_text(spark, str(tmp_path / "lex.txt")).select("named_entity", "id", "rank").collect())) == [("a b", "Q9", 0), ("c", "Q3", 0)]
    (tmp_path / "lex.jsonl").write_text('{"named_entity": "x", "entity_list": {"Q2": ["P1"], "Q1": []}}\n')
    assert [r["id"] for r in K.read_lexicon_json(spark, str(tmp_path / "lex.jsonl")).orderBy("rank").collect()] == ["Q2", "Q1"]
    (tmp_path / "s.conll").write_text("0 Q1 Q2\n1-2 du P _\n1 de P _\n2 le D _\n3 chat N Q5\n\n1 et C AND\n")
    toks, answers = K.read_annotated(spark, str(tmp_path / "s.conll"))
    assert [(r["surface"], r["macro"]) for r in toks.orderBy("sent_id", "lo").collect()] == [("du", "_"), ("chat", "Q5"), ("et", "AND")]
    assert [r["answers"] for r in answers.collect()] == [["Q1", "Q2"]]
    scores = spark.createDataFrame([("Q1", 0.5)], "id string, score double")
    sources.write_scores(scores, str(tmp_path / "scores"))
    assert [tuple(r) for r in sources.read_scores(spark, str(tmp_path / "scores")).collect()] == [("Q1", 0.5)]
    sources.write_edges(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "edges"))
    assert [tuple(r) for r in sources.read_edges(spark, str(tmp_path / "edges")).collect()] == [(1, 2)]


def snak(v, quals=None):
    return {"mainsnak": {"datavalue": {"value": v}} if v is not None else {"snaktype": "novalue"}, **({"qualifiers": quals} if quals else {})}


ENT = lambda i: {"id": i, "entity-type": "item"}
ITEMS = [
    {"id": "Q1", "labels": {"en": {"value": "One"}, "fr": {"value": "Un"}}, "aliases": {"fr": [{"value": "Une"}, {"value": "Un"}]}, "sitelinks": {"enwiki": {}}, "claims": {"P31": [snak(ENT("Q5"))], "P2": [snak(ENT("Q2"), {"P3": [{"datavalue": {"value": ENT("Q3")}}, {"datavalue": {"value": ENT("Q4")}}], "P4": [{"datavalue": {"value": "x"}}], "P5": [{"snaktype": "novalue"}]})], "P6": [snak("text", {"P3": [{"datavalue": {"value": ENT("Q7")}}]})]}},
    {"id": "Q2", "labels": {"fr": {"value": "Deux"}}, "sitelinks": {"a": {}}, "claims": {"P279": [snak(ENT("Q5"))]}},
    {"id": "P2", "labels": {"en": {"value": "prop"}}, "sitelinks": [], "claims": {"P31": snak(ENT("Q9"))}},
    {"id": "Q3", "labels": {"en": {"value": "no link"}}, "claims": {"P31": [snak(ENT("Q5"))]}},
]


def items(spark):
    lines = ["["] + [json.dumps(x) + "," for x in ITEMS] + ["broken", "]", None]
    return dump.read_items(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))


def test_dump_to_lexicon(spark):
    it = items(spark).cache()
    rows = {r["ent_idx"]: r for r in dump.entity_rows(it).collect()}
    assert set(rows) == {"Q1", "P2"} and rows["Q1"]["qlabels"] == "One;Un;Une" and rows["Q1"]["nclaims"] == 3
    assert sorted(" ".join(r["path_ids"]) for r in dump.paths(it).collect()) == ["P2 P31 Q9", "Q1 P2 Q2", "Q1 P2 Q2 P3 Q3", "Q1 P31 Q5", "Q1 P6 P3 Q7"]
    assert {r["id"]: r["names"] for r in dump.humans(it).collect()} == {"Q1": ["Un", "Une"], "Q3": ["no link"]}
    ranks = spark.createDataFrame([("Q1", 2), ("P31", 1), ("P2", 0), ("P6", 4), ("Q3", 9)], "id string, order long")
    base = {r["id"]: r for r in lexicon.lexicon_base(it, ranks).collect()}
    assert base["Q1"]["bridging"] == ["P2", "P31", "P6"] and base["P2"]["bridging"] is None
    assert "Q1" not in {r["id"] for r in lexicon.lexicon_base(it, ranks.filter("id <> 'P6'")).collect()}
    full = lexicon.lexicon_base(it, ranks)
    variants = {r["variant"] for r in lexicon.variants(full.filter("id = 'Q3'")).collect()}
    assert variants == {"no link", "No Link", "No link"}
    entries = sorted((r["named_entity"], r["pos"], r["id"]) for r in lexicon.dictionary(full, "order").collect())
    assert ("One", 0, "Q1") in entries and ("Ones", 0, "Q1") in entries and ("props", 0, "P2") in entries


def test_registered_dictionary_has_title_case(spark, tmp_path):
    rows = [(1, "Q1", "toll bridge", 3, "pont à péage", ["l'arc (x)", "pont"]), (2, "Q2", "bridge", 1, "pont", None), (3, "P7", "Pont À Péage", 2, None, []), (4, T.STOP_IDS[0], "pont", 0, None, None)]
    spark.createDataFrame(rows, "row_id long, id string, enlabel string, rank_order int, frlabel string, fraliase array<string>").write.parquet(str(tmp_path / "lexicon_base.parquet"))
    want = {}
    for _, i, en, o, fr, aliases in rows[:3]:
        for label in {x for x in (en, fr, *(aliases or [])) if x}:
            for form in {label, label.lower(), label.title(), label[:1].upper() + label[1:].lower(), *([label + "s"] if label == en and " " not in label else [])}:
                if not re.search(r"[*+()\[\]?\\]", form):
                    want.setdefault(form, set()).add((o, i))
    want = {(form, n, i) for form, ids in want.items() for n, (_, i) in enumerate(sorted(ids))}
    assert {("Pont À Péage", 0, "P7"), ("Pont À Péage", 1, "Q1"), ("Toll Bridge", 0, "Q1")} <= want
    got = [tuple(r) for r in etl_queries.etl_inverted_dictionary_full(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_linked_tokens_of_every_source(spark, tmp_path):
    spark.createDataFrame([(1, "Q1", "old bridge", 0, "pont")], "row_id long, id string, enlabel string, rank_order int, frlabel string").write.parquet(str(tmp_path / "lexicon_base.parquet"))
    spark.createDataFrame([(1, "pont et", "question_sets"), (2, "the old bridge", "talk"), (3, "pont", None), (4, None, "talk")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in etl_queries.text_linked_tokens(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert got == [(1, 0, "pont", "word", "Q1", "question_sets"), (1, 1, "et", "word", "AND", "question_sets"), (2, 0, "the", "word", None, "talk"), (2, 1, "old bridge", "key", "Q1", "talk"), (3, 0, "pont", "word", "Q1", None)]


@pytest.mark.parametrize("mode, extra", [(1, set()), (2, {("a", "c"), ("d", "g"), ("h", "j"), ("h", "l"), ("j", "l")})])
def test_edges(spark, mode, extra):
    df = spark.createDataFrame([(["a", "b", "c"],), (["d", "e", "f", "g"],), (["h", "i", "j", "k", "l"],), (["a", "b", "c"],), (None,), ([],), (["z"],), (["a", None],)], "path_ids array<string>")
    chain = {("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("h", "i"), ("i", "j"), ("j", "k"), ("k", "l")}
    rows = [tuple(r) for r in rank.edges(df, mode).collect()]
    assert set(rows) == chain | extra and len(rows) == len(set(rows))


def test_pagerank_against_plain_iteration(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "c"), ("c", "e"), ("a", "b")]
    got = {r["id"]: r["score"] for r in rank.pagerank(spark.createDataFrame(links, "src string, dst string")).collect()}
    nodes, out = sorted({x for e in links for x in e}), {}
    for s, t in set(links):
        out.setdefault(s, []).append(t)
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        lost = sum(score[n] for n in nodes if n not in out)
        new = {n: 0.15 / 5 + 0.85 * lost / 5 for n in nodes}
        for s, ts in out.items():
            for t in ts:
                new[t] += 0.85 * score[s] / len(ts)
        score = new
    assert all(abs(got[n] - score[n]) < 1e-4 for n in nodes) and abs(sum(got.values()) - 1) < 1e-9
    assert rank.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def plain_pagerank(links, rounds):
    nodes, out = sorted({x for e in links for x in e}), {}
    for s, t in set(links):
        out.setdefault(s, []).append(t)
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(score[n] for n in nodes if n not in out)
        new = {n: (0.15 + 0.85 * lost) / len(nodes) for n in nodes}
        for s, ts in out.items():
            for t in ts:
                new[t] += 0.85 * score[s] / len(ts)
        score = new
    return score


def test_registered_ranks_converge(spark, tmp_path):
    rnd = random.Random(14)
    claims = {f"Q{i}": {"P31": f"Q{(i + 1) % 12}", **{f"P{p}": f"Q{rnd.randrange(12)}" for p in rnd.sample(range(2, 7), 2)}} for i in range(12)}
    links = sorted({e for q, ps in claims.items() for p, o in ps.items() for e in ((q, p), (p, o))})
    lines = [json.dumps({"id": q, "labels": {"en": {"value": q}}, "sitelinks": {"a": {}}, "claims": {p: [snak(ENT(o))] for p, o in ps.items()}}) for q, ps in claims.items()]
    spark.createDataFrame(list(enumerate(lines)), "line_no long, line string").write.parquet(str(tmp_path / "dump_lines.parquet"))
    spark.createDataFrame([([q, p, o],) for q, ps in claims.items() for p, o in ps.items()], "path_ids array<string>").write.parquet(str(tmp_path / "statement_paths.parquet"))
    want = plain_pagerank(links, 300)
    order = lambda score: sorted(score, key=lambda n: (-score[n], n))
    assert order(want) != order(plain_pagerank(links, 3)) and min(a - b for a, b in zip(sorted(want.values(), reverse=True), sorted(want.values(), reverse=True)[1:])) > 1e-4
    got = {r["id"]: r["score"] for r in etl_queries.graph_pagerank_converged(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and sum(abs(got[n] - want[n]) for n in want) < 1e-4 < sum(abs(plain_pagerank(links, 5)[n] - want[n]) for n in want)
    place = {n: i for i, n in enumerate(order(want))}
    base = {r["id"]: r for r in etl_queries.etl_lexicon_base(spark, str(tmp_path)).collect()}
    assert {q: r["order"] for q, r in base.items()} == {q: place[q] for q in claims}
    assert {q: r["bridging"] for q, r in base.items()} == {q: "|".join(sorted(ps, key=place.get)) for q, ps in claims.items()}


def test_indexes_and_sums_with_a_hot_group(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 7 if i % 5 else None, "x") for i in range(600)], "id long, g string, v long, __t string")
    rows = skew.prefix_sum(df, ["g"], ["id"], "v", "before").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["before"], r["v"] or 0))
    for g, xs in by.items():
        at = 0
        for before, v in sorted(xs):
            assert before <= at or v >= 0
        assert sorted(b for b, _ in xs)[0] == 0 and max(b + v for b, v in xs) == sum(v for _, v in xs)
    pos = {r["id"]: r["p"] for r in skew.ordered_position(df, ["g"], "v", ["id"], "p", width=2).collect()}
    want = {}
    for g in by:
        own = sorted((r["v"] is None, r["v"] or 0, r["id"]) for r in rows if r["g"] == g)
        want |= {i: n for n, (_, _, i) in enumerate(own)}
    assert pos == want
    index = {r["id"]: r["n"] for r in skew.dense_index(df, [F.desc("id")], "n").collect()}
    assert index == {i: 599 - i for i in range(600)}
    assert skew.dense_index(df.limit(0), ["id"], "n").count() == 0


def test_stream_of_dump_pieces(spark, tmp_path):
    lines = [(i, "d", None, json.dumps(x)) for i, x in enumerate(ITEMS)]
    schema = "line_no long, dump_name string, read_at timestamp, line string"
    for k in (0, 2):
        spark.createDataFrame(lines[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.shred_stream(streaming.dump_stream(spark, str(tmp_path / "in")), DUMP_PATHS, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("node_path = 'labels.*'").count() == 5
