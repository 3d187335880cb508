import math
import random

from graphloom.llm import cut_texts


def table(spark, n=900):
    rnd = random.Random(3)
    places = ["".join(rnd.choice(["mor", "vel", "cha", "sau", "ker", "lun"]) + rnd.choice(["bray", "vigny", "court", "mare", "lene"]) for _ in range(1)).capitalize() for _ in range(40)]
    rows, cut = [], set()
    for i in range(n):
        labels = [f"{rnd.choice(['château', 'pont', 'gare'])} de {rnd.choice(places)}" for _ in range(rnd.randint(2, 7))]
        text = "; ".join(labels)
        if i % 3 == 0 and len(text) > 80:
            text = text[:80]
            cut.add(i)
        ident = f"Q1000{i:05d}" if i % 2 else f"Q30{i:06d}"
        if i % 3 == 1:
            ident = f"kb:item:{ident}"
        rows.append((i, ident[:16], text, "lim" if i % 3 == 0 else "ns" if i % 3 == 1 else None, "x", 1))
    rows += [(n, None, None, "lim", None, 1), (n + 1, "", "", "lim", None, 1), (n + 2, "  ", " ; ", None, None, 1)]
    return spark.createDataFrame(rows, "row_id long, ent_idx string, qlabels string, src_name string, value string, score int"), cut


def test_planted_cuts(spark):
    df, cut = table(spark)
    got = {r["row_id"] for r in cut_texts.cut_lists(df, "row_id", "qlabels", "src_name", "ent_idx").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.02 * 900
    codes = {r["row_id"] for r in cut_texts.cut_codes(df, "row_id", "ent_idx").collect()}
    assert codes == {i for i in range(900) if i % 3 == 1}


def test_empty_table(spark):
    df, _ = table(spark, 3)
    assert cut_texts.cut_lists(df.limit(0), "row_id", "qlabels", "src_name", "ent_idx").count() == 0
    assert cut_texts.cut_codes(df.limit(0), "row_id", "ent_idx").count() == 0


def test_open_quote_is_cut(spark):
    df = spark.createDataFrame([(1, "Q1", '"pont de Mor"; "gare', "s"), (2, "Q2", '"pont de Mor"; "gare"', "s"), (3, "Q3", '["a", "b', "s"), (3, "Q3", '["a", "b', "s")], "row_id long, ent_idx string, qlabels string, src_name string")
    assert {r["row_id"] for r in cut_texts.cut_lists(df, "row_id", "qlabels", "src_name", "ent_idx").collect()} == {1, 3}


def test_limits(spark):
    df, _ = table(spark)
    limits = {s: n for s, unit, n, _ in cut_texts.field_limits(df, "src_name", "qlabels")}
    assert limits.get("lim") in (80, 84, 85, 86, 87, 88)


def test_contexts_never_seen_back_off(spark):
    rnd = random.Random(5)
    values = ["".join(chr(rnd.randrange(97, 123)) for _ in range(40)) for _ in range(4000)]
    model = cut_texts.train(spark.createDataFrame([(v,) for v in values], "value string"), lambda _: "x")
    ends, more = {}, {}
    for v in values:
        for i in range(1, len(v) + 1):
            for k in range(1, cut_texts.ORDER + 1):
                if i >= k - 1:
                    at = ("\x02" + v[:i])[-k:]
                    side = ends if i == len(v) else more
                    side[at] = side.get(at, 0) + 1
    contexts = {*ends, *more}
    assert len(contexts) > 1 << 20 and model.counts.count() == len(contexts)
    model.curves = {}
    texts = [*values[:50], *(v[:20] for v in values[:50]), *(v[::-1] for v in values[:50])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(texts)], "id long, value string, lang string, n long")
    got = {r["id"]: r["score"] for r in model.odds(df).collect()}
    first = rate = (4000 + 0.5) / (4000 * 40 + 10.0)
    for i, v in enumerate(texts):
        rate = first
        for k in range(1, min(cut_texts.ORDER, len(v) + 1) + 1):
            at = ("\x02" + v)[-k:]
            e, m = ends.get(at, 0), more.get(at, 0)
            rate = (e + cut_texts.BACKOFF * rate) / (e + m + cut_texts.BACKOFF)
        want = max(-cut_texts.MOST, min(cut_texts.MOST, math.log((1 - rate) / rate) - math.log((1 - first) / first)))
        assert abs(got[i] - want) < 1e-9


def test_curves_learn_from_every_whole_value(spark):
    values = [f"{i:06d}" for i in range(120_000)]
    model = cut_texts.train(spark.createDataFrame([(v,) for v in values], "value string"), lambda _: "x", cut_texts.LABEL_ORDER)
    assert model.labelled.filter("NOT inside").select("value").distinct().count() == len(values)
    assert {r["value"] for r in model.labelled.filter("inside").select("value").distinct().collect()} == {v[:i] for v in values for i in range(1, 6)}


def test_every_place_weighs_its_share(spark):
    values = ["pont de Morbray", "pont de Morbray", "gare", "a", "rue de Morbray", "ab", "xxxx"]
    tag = lambda t: str(len(t) > 3)
    model = cut_texts.train(spark.createDataFrame([(v,) for v in values], "value string"), tag, 5)
    got = {(r["value"], r["lang"], r["inside"]): r["n"] / cut_texts.WEIGHT for r in model.labelled.collect()}
    want = {}
    for v in values:
        for i in range(1, len(v) + 1):
            at = (v[:i][-5:], tag(v[:i]), i < len(v))
            want[at] = want.get(at, 0) + (1 / (len(v) - 1) if i < len(v) else 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    # the characters that a score looks at tell as much as all that is before a place
    texts = [v[:i] for v in values for i in range(1, len(v) + 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(t[-5:] for t in texts)])], "id long, value string")
    score = {r["id"]: r["score"] for r in model.odds(df).collect()}
    assert all(score[i] == score[i + len(texts)] for i in range(len(texts)))


def test_languages_learn_from_every_value(spark):
    letters = [chr(c) for c in range(0x100, 0x250) if chr(c).islower()]
    known = [(str(i), lang) for i in range(12_000) for lang in "xy"] + [(ch * 3, "xy"[i % 2]) for i, ch in enumerate(letters)]
    tag = cut_texts.language_model(spark.createDataFrame(known, "value string, lang string"))
    assert [tag(ch * 3) for ch in letters] == ["xy"[i % 2] for i in range(len(letters))]


def test_languages_of_beginnings(spark):
    known = [(w, "fr") for w in ("château de Vigny", "l'île", "gare")] + [(w, "en") for w in ("castle of Vigny", "the isle", "station")]
    texts = ["", "a", "château of the isle", "İle de İstanbul", "Πόλις", "gare ΑΣ", "the 駅 station", "Ⱥ gare", "état… 100 %"]
    for tag in (cut_texts.language_model(spark.createDataFrame(known, "value string, lang string")), cut_texts.language_model(None)):
        for t in texts:
            assert tag.beginnings(t) == [tag(t[:i]) for i in range(1, len(t) + 1)]


def test_closed_values_are_whole(spark):
    texts = ["gare", "gare; pont de", '"gare", "pont"', '"gare" ; "pont" \n', '["gare", "pont"]', '["gare", "pont" ] ', 'le "pont"', "[pont]", '"le ""pont"""', '["a]"]', '"a]"', 'gare; "pont']
    values = ["gare", "pont de", "pont", "pont", "pont", "pont", 'le "pont"', "[pont]", 'le "pont"', "a]", "a]", "pont"]
    df = spark.createDataFrame(list(zip(texts, values)), "text string, value string")
    assert [r[0] for r in df.select(cut_texts._closing("text") > cut_texts._closing("value")).collect()] == [False] * 2 + [True] * 4 + [False] * 2 + [True] * 3 + [False]
