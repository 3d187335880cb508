import pytest

from graphloom.operators.packed import blocks, split_packed


def split(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, qlabels string, pos string, label_value string")
    out = {}
    for r in sorted(split_packed(df, "row_id", "qlabels").collect(), key=lambda r: (r["row_id"], r["pos"])):
        assert r["pos"] == len(out.setdefault(r["row_id"], []))
        out[r["row_id"]].append(r["label_value"])
    return out


def test_styles(spark):
    texts = ["a; b ;c；d | e • f", '"a; b" | c', '["x", "y \\"z\\" \\u00e9", ""]', '"He said ""no"""; b', "one, two", '"a, b", c', "Saint-A/B;c", "A / B / C/D", "église \\; école;x", "a;;b; ;", "x, y; z", '["a", "b', '"a";"b c', "p\tq\nr", "a,,b", "Kâ & Cie…"]
    got = split(spark, [(i, t, "p", "l") for i, t in enumerate(texts)])
    want = [["a", "b", "c", "d", "e", "f"], ["a; b", "c"], ["x", 'y "z" é'], ['He said "no"', "b"], ["one", "two"], ["a, b", "c"], ["Saint-A/B", "c"], ["A", "B", "C/D"], ["église ; école", "x"], ["a", "b"], ["x, y", "z"], ["a", "b"], ["a", "b c"], ["p", "q", "r"], ["a", "b"], ["Kâ & Cie…"]]
    assert [got[i] for i in range(len(texts))] == want


def test_nulls_blanks_repeats_and_long(spark):
    long = ";".join(f"label {i}" for i in range(20000))
    got = split(spark, [(1, None, None, None), (2, "", "", ""), (3, "  ", "", ""), (4, ";;", "", ""), (5, "a;b", "", ""), (6, "a;b", "", ""), (7, long, "", "")])
    assert set(got) == {5, 6, 7} and got[5] == got[6] == ["a", "b"] and len(got[7]) == 20000
    assert split(spark, []) == {}


def test_many_commas_and_known_values(spark):
    # "Vig, pont" was seen for certain, so where only commas stand it may be one value; the others part
    rows = [(i, '["Vig, pont", "b"]', "", "") for i in range(20)] + [(100, "Vig, pont", "", ""), (101, ",".join(f"v{i}" for i in range(300)), "", "")]
    got = split(spark, rows)
    assert len(got[101]) == 300 and got[0] == ["Vig, pont", "b"]


@pytest.mark.parametrize("text", ["\\", '"', '""', '"""', "[", '["', "[]", "[1, null]", "\\;", '"a"b', "/", ",", " / ", 'a "b" c'])
def test_odd_texts_do_not_crash(text):
    blocks(text)


def test_values_with_many_inner_marks(spark):
    # seven sites inside one value, known from quoted rows: more than any span set beforehand
    one = "rue A, bât. B, esc. C, porte D, lieu E, ville F, pays G, monde H"
    rows = [(i, f'"{one}"; x{i}', "", "") for i in range(30)] + [(100, f"début, {one}, fin", "", ""), (101, one, "", "")]
    got = split(spark, rows)
    assert got[100] == ["début", one, "fin"] and got[101] == [one]


def test_lattice_against_all_paths():
    import itertools
    import math

    from graphloom.operators.packed import Lattice

    parts, gaps = ["ab", "c", "de", "f"], [", ", "/", ","]
    arcs = [{"i": i, "j": i + 1, "label_value": p, "gap": g, "c": c} for i, (p, g, c) in enumerate(zip(parts, gaps + [""], [5.0, 0.0, 2.0, 9.0]))]
    arcs.append({"i": 1, "j": 3, "label_value": "c/de", "gap": "", "c": 4.0})
    lattice = Lattice(arcs, 50.0, 0.2, {",": 0.8, "/": 0.1})
    paths = []
    for on in itertools.product([0, 1], repeat=3):
        w, start = 0.0, 0
        spans = []
        for j, x in enumerate([*on, 1]):
            if x:
                spans.append((start, j + 1))
                start = j + 1
        for use in itertools.product([0, 1], repeat=len(spans)):
            if any(u and s != (1, 3) for u, s in zip(use, spans)):
                continue
            w = sum(math.log(0.8 * 4 / 50) if u else sum(lattice.single[i:j]) for u, (i, j) in zip(use, spans))
            w += sum(lattice.cuts[g] if x else lattice.keeps[g] for g, x in enumerate(on))
            paths.append((w, spans, on))
    total = math.log(sum(math.exp(w) for w, *_ in paths))
    whole, own, at = lattice.posterior()
    assert abs(whole - total) < 1e-9 and lattice.best() == max(paths)[1]
    for g in range(3):
        assert abs(at[g] - sum(math.exp(w - total) for w, _, on in paths if on[g])) < 1e-9
    for i in range(4):
        assert abs(own[i] - sum(math.exp(w - total) for w, spans, _ in paths if (i, i + 1) in spans)) < 1e-9
