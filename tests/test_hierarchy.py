import random

from graphloom.operators import hierarchy as H


def run(spark, links):
    df = spark.createDataFrame(links, "c string, p string")
    tree = H.tree_links(df, "c", "p")
    return tree, H.nested_sets(tree)


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    ids = {x for link in links for x in link if x is not None}
    out = {}
    for n in ids:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            out[n] = (min(ring), -1 if n in ring else -2)
        else:
            out[n] = (x, len(seen))
    return out, parent


def check(spark, links):
    tree, sets = run(spark, links)
    sets = sets.cache()
    rows = {r["id"]: r for r in sets.collect()}
    want, parent = brute(links)
    assert {k: (r["root_id"], r["tree_depth"]) for k, r in rows.items()} == want
    above = {}
    for n in want:
        if want[n][1] >= 0:
            x, chain = n, []
            while x in parent:
                x = parent[x]
                chain.append(x)
            above[n] = chain
    inside = {(a, b) for a in above for b in above if a != b and rows[a]["root_id"] == rows[b]["root_id"] and rows[a]["lft"] < rows[b]["lft"] <= rows[a]["rgt"]}
    assert inside == {(a, n) for n, chain in above.items() for a in chain}
    got = {(r["id"], r["descendant"]) for r in H.descendants(sets, sets.select("id")).collect()}
    assert got == inside
    paths = {r["id"]: r["tree_path"] for r in H.paths(tree, sets).collect()}
    assert all(paths[n] == ("/".join([n, *above[n]][::-1]) if n in above else None) for n in want)


def test_forest_with_circles(spark):
    rnd = random.Random(5)
    links = [(f"n{i}", f"n{rnd.randrange(0, i)}") for i in range(1, 60)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "d"), ("s", "s"), ("t", "s"), (None, "lone"), ("x", None), ("n3", "n0"), ("n3", "n0")]
    check(spark, links)


def test_long_chain_and_star(spark):
    check(spark, [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [(f"k{i}", "hub") for i in range(80)])


def test_long_circle_alone(spark):
    check(spark, [(f"r{(i * 7) % 23:02d}", f"r{((i + 1) * 7) % 23:02d}") for i in range(23)])


def test_empty(spark):
    _, sets = run(spark, [])
    assert sets.count() == 0


def test_other_parents(spark):
    df = spark.createDataFrame([("a", "r"), ("a", "s"), ("a", "s"), ("b", "r"), (None, "r"), ("c", None)], "c string, p string")
    assert [tuple(r) for r in H.other_parents(df, "c", "p").collect()] == [("a", "s")]
