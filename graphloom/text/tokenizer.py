"""Tokens with multi-word keys, and readers of questions.

The lexicon's keys with a blank make tries, of max_vocab keys at most, that executors build; all else joins.
"""

from __future__ import annotations

import gzip
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut
from graphloom.text import functions as T

#: Keys that a trie may hold; more are matched in several passes.
MAX_VOCAB = 1_000_000
#: Tokens of a batch sent back, beside those of its last text.
SENT = 50_000

# The intended compounds of the pattern list, pieces joined by '+'.
COMPOUNDS = """\\.+\\.+\\. \\.+\\. aujourd'+hui celui+-+ci celui+-+là celle+-+ci celle+-+là celles+-+ci celles+-+là ceux+-+ci ceux+-+là
là+-+bas prud'+homme prud'+hommes arc+-+en+-+ciel c'+est+-+à+-+dire rendez+-+vous""".split()


def compound_regex(lines: Iterable[str] = COMPOUNDS, compat: bool = False) -> str:
    """One pattern for the compounds.

    By default a line's pieces belong together, with an optional blank between them. compat takes each first
    piece followed by a blank as a compound of its own, which is what a list of unjoined alternatives matches.
    """
    pieces = [[re.sub(r"\s+", " ", p.strip()) for p in line.rstrip("\n").split("+")] for line in lines if line.strip()]
    if compat:
        words = sorted({p[0] + " " for p in pieces if len(p) > 1}, key=len, reverse=True)
        return "(?:" + "|".join(words) + ")"
    words = sorted((" ?".join(p) for p in pieces), key=len, reverse=True)
    extra = [r"[0-9]+(?: [/,.] ?[0-9]+| [0-9]{3}\b)+", r"[0-9]+ ?(?:ème|eme|er|e|è)\b", r"(?:- ?)+", r"(?:[A-ZÊÙÈÀÂÔÎÉÁ] \. ?){2,}", r"(?:https? : / / |www )[\w .\-/]*\w"]
    return "(?:" + "|".join(f"(?:{w})" for w in [*words, *extra]) + r")(?= |$)"


class Trie:
    """Longest key that begins a text at a place."""

    def __init__(self, keys: Iterable[str]) -> None:
        self.root: dict = {}
        for key in keys:
            at = self.root
            for ch in key:
                at = at.setdefault(ch, {})
            at[""] = True

    def longest(self, text: str, start: int) -> int:
        """Where the longest key at start ends; start if none does. The key may end inside a word."""
        at, best, i = self.root, start, start
        while i < len(text) and text[i] in at:
            at = at[text[i]]
            i += 1
            if "" in at:
                best = i
        return best

    def keys(self) -> Iterator[str]:
        """All keys, by depth first."""
        todo = [("", self.root)]
        while todo:
            text, at = todo.pop()
            for ch in sorted(at, reverse=True):
                if ch:
                    todo.append((text + ch, at[ch]))
            if "" in at:
                yield text

    def save(self, path: str) -> None:
        """Front-coded keys, gzipped: of each key the number of characters it shares with the one before, and the rest."""
        with gzip.open(path, "wt", encoding="utf-8", errors="surrogatepass", newline="\n") as f:
            before = ""
            for key in self.keys():
                n = 0
                while n < min(len(key), len(before)) and key[n] == before[n]:
                    n += 1
                f.write(json.dumps([n, key[n:]]) + "\n")
                before = key

    @classmethod
    def load(cls, path: str) -> Trie:
        def read() -> Iterator[str]:
            with gzip.open(path, "rt", encoding="utf-8", errors="surrogatepass") as f:
                before = ""
                for line in f:
                    n, rest = json.loads(line)
                    before = before[:n] + rest
                    yield before

        return cls(read())


class Ends:
    """Longest keys found beforehand, by where they begin in one text."""

    def __init__(self, ends: dict[int, int]) -> None:
        self.ends = ends

    def longest(self, text: str, start: int) -> int:
        return self.ends.get(start, start)


def tokens_of(text: str, trie: Trie | Ends, compound: re.Pattern | None) -> list[tuple[str, str]]:
    """(form, kind) of a normalised text; kind is compound, key or word."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = compound.match(text, at) if compound else None
        if m and m.end() > at:
            out.append((m.group().replace(" ", ""), "compound"))
            at = m.end()
            continue
        end = trie.longest(text, at)
        if end > at:
            out.append((text[at:end], "key"))
        else:
            end = at
            while end < len(text) and not text[end].isspace():
                end += 1
            out.append((text[at:end], "word"))
        at = end
    return out


def tokenize(df: DataFrame, key: str, text: str, lexicon: DataFrame, max_vocab: int = MAX_VOCAB, compounds: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, form, kind) and the columns `keep`: tokens of `text`, multi-word keys of the lexicon (named_entity, rank) in one piece.

    Null and empty texts give no rows. More keys than max_vocab are matched in passes of that many each, by hash: each pass
    notes where its keys begin and end in every text, the longest of all passes count.
    """
    sc = df.sparkSession.sparkContext
    keys = lexicon.filter(F.col("named_entity").contains(" ")).select("named_entity").distinct()
    n_keys = keys.count()
    texts = df.select(F.col(key).cast("long").alias(key), T.normalize(F.col(text)).alias("t"), *keep)
    pattern, held = compounds, None
    passes = -(-n_keys // max_vocab)
    if passes <= 1:
        held = sc.broadcast([r[0] for r in keys.toLocalIterator()])  # max_vocab keys at most
        texts = texts.withColumn("__ends", F.lit(None).cast("array<struct<at:int,end:int>>"))
    else:
        texts = cut(texts.withColumn("__n", F.monotonically_increasing_id()))
        met = None
        parts = 2 * passes  # a part by hash is a little uneven: half of max_vocab on average
        for i in range(parts):
            part = sc.broadcast([r[0] for r in keys.filter(F.pmod(F.xxhash64("named_entity"), F.lit(parts)) == i).toLocalIterator()])
            found = texts.select("__n", "t").mapInArrow(_begins(part), "__n long, at int, end int")
            met = found if met is None else met.unionByName(found)
        longest = met.groupBy(F.col("__n").alias("__m"), "at").agg(F.max("end").alias("end")).groupBy("__m").agg(F.collect_list(F.struct("at", "end")).alias("__ends"))
        texts = texts.join(longest, F.col("__n") == F.col("__m"), "left").withColumn("__ends", F.coalesce("__ends", F.array().cast("array<struct<at:int,end:int>>"))).select(key, "t", *keep, "__ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rx = Trie(held.value) if held else None, re.compile(pattern) if pattern else None
        for b in batches:
            ends = b.column(b.num_columns - 1).to_pylist()
            at, pos, forms, kinds = [], [], [], []

            def rows() -> pa.RecordBatch:
                own = [b.column(i).take(pa.array(at, pa.int64())) for i in (0, *range(2, b.num_columns - 1))]
                return pa.RecordBatch.from_arrays([own[0], pa.array(pos, pa.int32()), pa.array(forms, pa.string()), pa.array(kinds, pa.string()), *own[1:]], names=[key, "pos", "form", "kind", *keep])

            for n, t in enumerate(b.column(1).to_pylist()):
                index = trie or Ends({x["at"]: x["end"] for x in ends[n]})
                for i, (form, kind) in enumerate(tokens_of(t or "", index, rx)):
                    at.append(n)
                    pos.append(i)
                    forms.append(form)
                    kinds.append(kind)
                if len(at) >= SENT:
                    yield rows()
                    at, pos, forms, kinds = [], [], [], []
            yield rows()

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(run, f"`{key}` long, pos int, form string, kind string{kept}")


def _begins(part):
    """Where keys of one part begin and end in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(part.value)
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, ch in enumerate(t or ""):
                    if ch in trie.root and (end := trie.longest(t, i)) > i:
                        out.append((n, i, end))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.int32())], names=["__n", "at", "end"])

    return run


def read_compounds(spark: SparkSession, path: str) -> list[str]:
    """The lines of a compound dictionary, pieces joined by '+'; # starts a comment. A dictionary's lines come to the driver."""
    lines = (r["value"].split("#", 1)[0].strip() for r in spark.read.text(path).toLocalIterator())
    return [x for x in lines if x]


def link(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens with `macro`: the first property among the entities of a form, else the best-ranked, or its function word.

    Compounds are looked up nowhere. The lexicon (named_entity, id, rank) is reduced to one row a key before the join.
    """
    best = lexicon.groupBy("named_entity").agg(F.min_by("id", F.struct((~F.col("id").startswith("P")).alias("item"), "rank", "id")).alias("linked"))
    out = tokens.join(best, (F.col("form") == F.col("named_entity")) & (F.col("kind") != "compound"), "left")
    word = T.function_word(F.col("form"))
    return out.withColumn("macro", F.coalesce(F.when(word.isin("AND", "OR"), word), F.col("linked"), word)).drop("named_entity", "linked")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records, one JSON object a line."""
    return spark.read.schema("utterance string, utterance_fr string, targetValue string").json(path)


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, answers) of blank-line separated sentences with columns idx surface postag macro.

    A row idx of the form i-j stands for the rows i to j, which are dropped; a line that starts with 0 lists answers.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("sent_id", F.monotonically_increasing_id())
    lines = blocks.select("sent_id", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("n", "line")).filter("trim(line) <> ''")
    answers = lines.filter(F.col("line").startswith("0")).select("sent_id", F.slice(F.split(F.trim("line"), r"\s+"), 2, 1000000).alias("answers"))
    cols = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(~F.col("line").startswith("0")).select("sent_id", "n", cols.alias("c"))
    span = F.split(F.get("c", F.lit(0)), "-")
    rows = rows.select("sent_id", F.get(span, F.lit(0)).cast("int").alias("lo"), F.coalesce(F.get(span, F.lit(1)), F.get(span, F.lit(0))).cast("int").alias("hi"), F.get("c", F.lit(1)).alias("surface"), F.get("c", F.lit(2)).alias("postag"), F.get("c", F.lit(3)).alias("macro"))
    ranges = rows.filter("hi > lo").select(F.col("sent_id").alias("s"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    kept = rows.join(ranges, (F.col("sent_id") == F.col("s")) & (F.col("lo") == F.col("hi")) & F.col("lo").between(F.col("a"), F.col("b")), "left_anti")
    return kept, answers


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """(named_entity, id, rank, bridging) of a JSON lexicon; of a key that comes again the last line counts."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    rows = lines.select("line_no", F.from_json("value", "named_entity string, entity_list map<string, array<string>>").alias("x")).select("line_no", "x.*").filter("named_entity IS NOT NULL")
    last = rows.groupBy("named_entity").agg(F.max_by("entity_list", "line_no").alias("entity_list"))
    return last.select("named_entity", F.posexplode(F.map_entries("entity_list")).alias("rank", "e")).select("named_entity", F.col("e.key").alias("id"), "rank", F.col("e.value").alias("bridging"))


def read_lexicon_text(spark: SparkSession, path: str) -> DataFrame:
    """(named_entity, id, rank) of lines 'key ::: id;id'."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split("value", " ::: ", 2)
    rows = lines.select("line_no", F.trim(F.get(parts, F.lit(0))).alias("named_entity"), F.split(F.trim(F.get(parts, F.lit(1))), ";").alias("ids")).filter("ids IS NOT NULL")
    last = rows.groupBy("named_entity").agg(F.max_by("ids", "line_no").alias("ids"))
    return last.select("named_entity", F.posexplode("ids").alias("rank", "id")).filter("id <> ''")


def longest_prefix(texts: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """(key, named_entity): the longest key that begins each text.

    Keys and texts are sorted together, byte by byte; all that lies between a key and a text it begins begins with it, too, so a
    part of the sorted rows meets its keys in one pass. A key of an earlier part also begins the part's first row: texts that
    met no key carry what they share with that row, and are looked up by it.
    """
    known = keys.filter("named_entity IS NOT NULL").select(F.col("named_entity").cast("binary").alias("s")).distinct()
    longest = known.agg(F.max(F.octet_length("s"))).first()[0]
    if longest is None:
        return texts.select(key, F.lit(None).cast("string").alias("named_entity")).limit(0)
    kind = texts.schema[key].dataType
    asked = texts.filter(F.col(text).isNotNull()).select(F.substring(F.col(text).cast("binary"), 1, longest).alias("s"), F.lit(True).alias("asked"), F.col(key).alias("k"))
    rows = asked.unionByName(known.select("s", F.lit(False).alias("asked"), F.lit(None).cast(kind).alias("k")))
    met = cut(rows.repartitionByRange("s", "asked", "k").sortWithinPartitions("s", "asked").mapInArrow(_begun, f"k {kind.simpleString()}, hit binary, head binary"))
    heads = met.filter("hit IS NULL").select("head").distinct()
    sizes = known.select(F.octet_length("s").alias("n")).distinct()
    begins = heads.join(sizes, F.col("n") <= F.octet_length("head")).select("head", F.substring("head", F.lit(1), F.col("n")).alias("s"))
    found = begins.join(known, "s").groupBy("head").agg(F.max_by("s", F.octet_length("s")).alias("hit"))
    hits = met.filter("hit IS NOT NULL").select("k", "hit").unionByName(met.filter("hit IS NULL").select("k", "head").join(found, "head").select("k", "hit"))
    name = F.col("hit").cast("string")
    return hits.groupBy(F.col("k").alias(key)).agg(F.max_by(name, F.struct(F.length(name), name)).alias("named_entity"))


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, hit, head) of the texts of sorted rows (s, asked, k): the longest key among the rows that begins each; without one, what it shares with the first row."""
    first, open_keys = None, []  # each of the keys begins the next
    for b in batches:
        at, hits, heads = [], [], []
        for n, (s, asked) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            first = s if first is None else first
            while open_keys and not s.startswith(open_keys[-1]):
                open_keys.pop()
            if not asked:
                open_keys.append(s)
                continue
            at.append(n)
            hits.append(open_keys[-1] if open_keys else None)
            heads.append(None if open_keys else os.path.commonprefix([first, s]))
        yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(at, pa.int64())), pa.array(hits, pa.binary()), pa.array(heads, pa.binary())], names=["k", "hit", "head"])
