"""Parent-child rows as full hierarchies: nested-set ranges, roots, depths, paths, circles.

All passes double their reach in every round, so a chain of a million links takes twenty rounds, and
every round is one join of narrow rows. Upward rounds add up subtree sizes; prefix sums over siblings
turn them into preorder ranges; downward rounds add those up along the way to the root. What the upward
rounds never finish lies on a circle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import prefix_sum
from graphloom.session import cut


def tree_links(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent) with one row for every id on either side; parent is null for ids without one.

    Repeated links count once; a link with a null side names no link, its other side still being an id.
    Of several parents the smallest is taken: a node of a tree has one. `other_parents` has the rest.
    """
    pairs = links.select(F.col(child).alias("id"), F.col(parent).alias("parent"))
    ends = pairs.select(F.explode(F.array(F.struct("id", "parent"), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))).alias("x"))
    return ends.select("x.*").filter("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"))


def other_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent): the distinct links that tree_links leaves out, to parents that aren't a node's smallest."""
    pairs = links.select(F.col(child).alias("id"), F.col(parent).alias("parent")).dropna().distinct()
    kept = pairs.groupBy(F.col("id").alias("__i")).agg(F.min("parent").alias("__p"))
    return pairs.join(kept, (F.col("id") == F.col("__i")) & (F.col("parent") != F.col("__p"))).select("id", "parent")


def _up(links: DataFrame) -> tuple[DataFrame, int]:
    """The state (id, parent, a0.., dist, size) after as many rounds as it takes, and how many rounds.

    a<k> is the ancestor 2^k steps up, null beyond the root. dist counts the steps found so far and
    size the nodes at most that far below, itself included.
    """
    state = cut(links.select("id", "parent", F.col("parent").alias("a0"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size")))
    k, open_now = 0, state.filter("a0 IS NOT NULL").count()
    while open_now:
        # nodes that have a 2^k-th ancestor: each takes that ancestor's pointer and gives it its size
        at = f"a{k}"
        over = state.select(F.col("id").alias("__j"), F.col(at).alias("__next"), F.col("dist").alias("__d"))
        gained = state.filter(F.col(at).isNotNull()).groupBy(F.col(at).alias("__k")).agg(F.sum("size").alias("__s"))
        moved = state.filter(F.col(at).isNotNull()).join(over, F.col(at) == F.col("__j")).drop("__j")
        rest = state.filter(F.col(at).isNull()).withColumns({"__next": F.lit(None).cast("string"), "__d": F.lit(0).cast("long")})
        both = moved.unionByName(rest).join(gained, F.col("id") == F.col("__k"), "left")
        state = cut(both.select(*[c for c in state.columns if c not in ("dist", "size")], F.col("__next").alias(f"a{k + 1}"), (F.col("dist") + F.col("__d")).alias("dist"), (F.col("size") + F.coalesce("__s", F.lit(0))).alias("size")), state)
        k += 1
        still = state.filter(F.col(f"a{k}").isNotNull()).count()
        if still == open_now:  # a node 2^k deep would have nodes of every smaller depth above it: none is left but circles
            break
        open_now = still
    return state, k


def _circles(state: DataFrame, k: int) -> DataFrame:
    """(id, root_id, tree_depth) of the nodes that never reach a root.

    Jumping far enough from anywhere lands on a circle, and on every node of it; the jumps are far enough
    once the set of landing places stops shrinking, and have seen the whole circle once no smaller id comes up.
    """
    lost = state.filter(F.col(f"a{k}").isNotNull())
    jump = cut(lost.select("id", F.col("parent").alias("to"), F.col("id").alias("low")))
    landed = -1
    while True:
        # low: the smallest id within the reach so far
        over = jump.select(F.col("id").alias("__j"), F.col("to").alias("__to"), F.col("low").alias("__low"))
        reached = jump.join(over, F.col("to") == F.col("__j"))
        jump = cut(reached.select("id", F.col("__to").alias("to"), F.least("low", "__low").alias("low"), (F.col("__low") < F.col("low")).alias("lower")), jump)
        now = jump.agg(F.count_distinct("to").alias("n"), F.coalesce(F.sum(F.col("lower").cast("long")), F.lit(0)).alias("lower")).first()
        # reaches that see nothing lower in the next reach, all around a circle, have seen all of it
        if now["n"] == landed and not now["lower"]:
            break
        landed = now["n"]
    on = cut(jump.select(F.col("to").alias("__on")).distinct())
    marked = cut(jump.join(on, F.col("id") == F.col("__on"), "left"))
    lows = marked.filter("__on IS NOT NULL").select(F.col("id").alias("__c"), F.col("low").alias("root_id"))
    # every node's root is the circle it lands on; a circle node lands on its own circle
    return marked.join(lows, F.col("to") == F.col("__c")).select("id", "root_id", F.when(F.col("__on").isNotNull(), -1).otherwise(-2).alias("tree_depth"))


def nested_sets(links: DataFrame) -> DataFrame:
    """(id, parent, root_id, tree_depth, lft, rgt, n_descendants) for every id of `links` (see tree_links).

    lft is a node's place in the preorder of its tree, from 0; its descendants are the nodes of the same root
    with lft < theirs <= rgt. Nodes on a circle have depth -1, nodes below one -2, both the circle's
    smallest id as root and no range. An empty table gives an empty table; a node that is its own parent
    is a circle of one.
    """
    state, k = _up(links)
    whole = state.filter(F.col(f"a{k}").isNull())
    # siblings' ranges: what the earlier ones need. Roots start their own trees.
    kids = prefix_sum(whole.filter("parent IS NOT NULL"), ["parent"], ["id"], "size", "__left").withColumn("step", F.col("__left") + 1).drop("__left")
    down = kids.unionByName(whole.filter("parent IS NULL").withColumn("step", F.lit(0).cast("long")))
    down = cut(down.withColumn("root_id", F.when(F.col("parent").isNull(), F.col("id"))).withColumn("lft", F.col("step")).drop("step"))
    for i in range(k):
        at = f"a{i}"
        over = down.select(F.col("id").alias("__j"), F.col("lft").alias("__l"), F.col("root_id").alias("__r"))
        moved = down.filter(F.col(at).isNotNull()).join(over, F.col(at) == F.col("__j"))
        moved = moved.withColumns({"lft": F.col("lft") + F.col("__l"), "root_id": F.coalesce("root_id", "__r")}).drop("__j", "__l", "__r", at)
        down = cut(moved.unionByName(down.filter(F.col(at).isNull()).drop(at)), down)
    trees = down.select("id", "parent", "root_id", F.col("dist").cast("int").alias("tree_depth"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"))
    none = F.lit(None).cast("long")
    if state.filter(F.col(f"a{k}").isNotNull()).isEmpty():
        return trees
    lost = _circles(state, k).join(links.withColumnRenamed("id", "__i"), F.col("id") == F.col("__i"))
    return trees.unionByName(lost.select("id", "parent", "root_id", "tree_depth", none.alias("lft"), none.alias("rgt"), none.alias("n_descendants")))


def descendants(sets: DataFrame, of: DataFrame) -> DataFrame:
    """(id, descendant, steps): all that lies below each id of `of`, by ranges.

    Ranges are cut into blocks of 1,024 preorder places, so the join is an equality on (root, block) with the
    range checked inside; its rows are the answers plus at most two blocks a queried id.
    """
    width = 1024
    tree = sets.filter("lft IS NOT NULL")
    ask = tree.join(of.select(F.col("id").alias("__q")).distinct(), F.col("id") == F.col("__q")).filter("n_descendants > 0")
    ask = ask.select(F.col("id").alias("anc"), F.col("root_id").alias("r"), F.col("lft").alias("lo"), F.col("rgt").alias("hi"), F.col("tree_depth").alias("d"), F.explode(F.sequence(F.floor((F.col("lft") + 1) / width), F.floor(F.col("rgt") / width))).alias("b"))
    found = tree.withColumn("__b", F.floor(F.col("lft") / width)).join(ask, (F.col("root_id") == F.col("r")) & (F.col("__b") == F.col("b")) & (F.col("lft") > F.col("lo")) & (F.col("lft") <= F.col("hi")))
    return found.select(F.col("anc").alias("id"), F.col("id").alias("descendant"), (F.col("tree_depth") - F.col("d")).alias("steps"))


def paths(links: DataFrame, sets: DataFrame, sep: str = "/") -> DataFrame:
    """(id, tree_path): the ids from the root down to the node, joined by sep; null on and below circles.

    Paths double in length every round as the reach does.
    """
    tree = sets.filter("lft IS NOT NULL")
    state = cut(tree.select("id", F.col("parent").alias("to"), F.col("id").alias("tree_path")))
    while not state.filter("to IS NOT NULL").isEmpty():
        over = state.select(F.col("id").alias("__j"), F.col("to").alias("__to"), F.col("tree_path").alias("__p"))
        moved = state.filter("to IS NOT NULL").join(over, F.col("to") == F.col("__j")).select("id", F.col("__to").alias("to"), F.concat_ws(sep, "__p", "tree_path").alias("tree_path"))
        state = cut(moved.unionByName(state.filter("to IS NULL")), state)
    rest = sets.filter("lft IS NULL").select("id", F.lit(None).cast("string").alias("tree_path"))
    return state.select("id", "tree_path").unionByName(rest)
