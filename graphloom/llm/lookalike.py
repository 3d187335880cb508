"""Texts that look the same brought to one form.

Pairs of strings and code points that look alike are joined to classes by union-find; each class takes its most
frequent member of a script as that script's form; an Aho-Corasick automaton rewrites texts, at each place the
longest pattern. Letters of another script are rewritten only where they stand in for those of the word around them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin ones that look the same.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝҮ", "ABESIJKMHOPCTYXaesijopcyxdhqwY"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανικορτυχ", "ABEZHIKMNOPTYXavikoptux"))
OTHER = {"օ": "o", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-"}
# Greek letters that are symbols where they stand alone.
SYMBOLS = set("αβγδεθλμπσφω")
# Decompositions that keep the looks; the others (superscripts, fractions, circles) don't.
SAME_LOOKS = {"", "<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"}

_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")


def script(ch: str) -> str:
    """LATIN, CYRILLIC or GREEK; 'CJK' for the scripts of East Asia; '' for any other."""
    name = unicodedata.name(ch, "")
    for s in _SCRIPTS:
        if name.startswith(s) or (s == "LATIN" and name.startswith("FULLWIDTH LATIN")):
            return s
    return "CJK" if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO")) else name.split(" ")[0] if unicodedata.category(ch)[0] == "L" else ""


def invisible(ch: str) -> bool:
    """Whether a code point shows nothing and takes no room."""
    return (unicodedata.category(ch) == "Cf" and not "؀" <= ch <= "؅" and ch not in "۝܏") or ch in "͏ᅟᅠ឴឵ㅤ" or "︀" <= ch <= "️"


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = s = self.up[self.up[s]]
        return s

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.up:
            out.setdefault(self.find(s), []).append(s)
        return list(out.values())


def _latin_twin(ch: str) -> str | None:
    """The Latin letter, accents kept, that a letter of another script looks like."""
    base, *marks = unicodedata.normalize("NFD", ch)
    twin = CYRILLIC.get(base) or GREEK.get(base) or OTHER.get(base)
    if twin is None:
        return None
    whole = unicodedata.normalize("NFC", twin + "".join(marks))
    return whole if len(whole) == 1 else None


def look_alikes(alphabet: Iterable[str]) -> Classes:
    """Classes of look-alikes among the strings (code points, or a letter with its combining marks) given."""
    classes = Classes()
    for s in alphabet:
        if len(s) == 1 and invisible(s):
            classes.union(s, "")
            continue
        nfc = unicodedata.normalize("NFC", s)
        if nfc != s:
            classes.union(s, nfc)
        if len(s) == 1:
            first, _, rest = unicodedata.decomposition(s).partition(" ")
            tag = first if first.startswith("<") else ""
            full = unicodedata.normalize("NFKC", s)
            cat = unicodedata.category(s)
            drawn = tag != "<compat>" or cat[0] in "LZ" or cat == "Nl"
            if full != s and tag in SAME_LOOKS and drawn and not (" " in full and cat != "Zs"):
                classes.union(s, full)
            if cat == "Zs":
                classes.union(s, " ")
        if len(nfc) == 1 and (twin := _latin_twin(nfc)):
            classes.union(nfc, twin)
    return classes


def rewriting(classes: Classes, counts: dict[str, int]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """What is rewritten everywhere, and for each script what is rewritten in its words.

    The form of a class in a script is its most frequent member of that script (ties: the smallest code
    point); of members without a script, the one that composition leaves alone and that is most frequent.
    """
    everywhere: dict[str, str] = {}
    by_script: dict[str, dict[str, str]] = {s: {} for s in _SCRIPTS}
    for members in classes.members():
        if "" in members:
            everywhere |= {m: "" for m in members if m}
            continue
        kept = [m for m in members if unicodedata.normalize("NFKC", m) == m] or members
        forms: dict[str, str] = {}
        for m in sorted(kept, key=lambda m: (-counts.get(m, 0), m)):
            forms.setdefault(script(m[0]) if m[0].isalpha() else "", m)
        for m in members:
            if m in kept and m[0].isalpha():
                for s in _SCRIPTS:
                    if s in forms and script(m[0]) != s and script(m[0]) in _SCRIPTS + ("ARMENIAN",):
                        by_script[s][m] = forms[s]
                continue
            folded = unicodedata.normalize("NFKC", m)
            own = script(folded[0]) if folded and folded[0].isalpha() else ""
            to = " " if " " in members and not folded.strip() else forms.get(own, folded) if len(folded) == 1 else folded
            if "-" in members:
                to = "-"
            if to != m:
                everywhere[m] = to
    return everywhere, by_script


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    marks = regex.compile(r"\P{M}\p{M}")  # one mark: longer runs come together by composing the text
    seen: Counter[str] = Counter()
    for batch in batches:
        for values in batch.column(0).to_pylist():
            for v in values or ():
                if v:
                    seen.update(v)
                    if not v.isascii():
                        seen.update(m for m in marks.findall(v) if unicodedata.normalize("NFC", m) != m)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])


class Rewriter:
    """One form for a text; made on each executor from the rewriting tables."""

    def __init__(self, everywhere: dict[str, str], by_script: dict[str, dict[str, str]]) -> None:
        import ahocorasick
        import regex

        self.always = ahocorasick.Automaton()
        for s, to in everywhere.items():
            self.always.add_word(s, (len(s), s, to))
        if everywhere:
            self.always.make_automaton()
        self.everywhere = everywhere
        self.by_script = by_script
        self.shared = {m for t in by_script.values() for m in t} | {f for t in by_script.values() for f in t.values()}
        self.words = regex.compile(r"[\p{L}\p{M}]+")
        self.kind: dict[str, str] = {}
        # a text without any of these, and composed, is in its one form
        signs = "".join(regex.escape(c, special_only=False) for c in sorted({s for s in everywhere if len(s) == 1}))
        self.doubtful = regex.compile(rf"[{signs}\p{{Script=Cyrillic}}\p{{Script=Greek}}\p{{Script=Armenian}}\p{{M}}]")

    def script(self, ch: str) -> str:
        if ch not in self.kind:
            self.kind[ch] = script(ch)
        return self.kind[ch]

    def _plain(self, text: str) -> str:
        """Everything rewritten that is so everywhere, the longest match first at each place."""
        if not self.everywhere:
            return text
        letters = [self.script(c) for c in text if c.isalpha()]
        east = "CJK" in letters and not any(c.isascii() and c.isalpha() for c in text)
        out, at = [], 0
        for end, (size, s, to) in self.always.iter_long(text):
            start = end - size + 1
            if east and (s == "　" or unicodedata.east_asian_width(s[0]) == "F"):
                continue  # wide forms are usual where the whole text is
            if s in "‌‍" and 0 < start and end + 1 < len(text) and self._joins(text[start - 1]) and self._joins(text[end + 1]):
                continue
            out += [text[at:start], to]
            at = end + 1
        return unicodedata.normalize("NFC", "".join(out) + text[at:]) if out else unicodedata.normalize("NFC", text)

    def _joins(self, ch: str) -> bool:
        """Whether a joiner beside this character is part of the writing: letters of joining scripts, pictures."""
        return unicodedata.category(ch) in ("So", "Sk") or (ch.isalpha() or unicodedata.category(ch)[0] == "M") and self.script(ch) not in (*_SCRIPTS, "CJK", "")

    def __call__(self, text: str) -> str:
        if text.isascii() or not self.doubtful.search(text) and unicodedata.is_normalized("NFC", text):
            return text
        text = self._plain(text)
        if text.isascii():
            return text
        words = list(self.words.finditer(text))
        own = Counter(self.script(c) for w in words for c in w.group() if c not in self.shared)
        everything = Counter(self.script(c) for w in words for c in w.group())
        of_text = next((s for s, _ in own.most_common() if s in _SCRIPTS), None) or next((s for s, _ in everything.most_common() if s in _SCRIPTS), None)
        if of_text is None:
            return text
        out, at = [], 0
        for w in words:
            word = w.group()
            scripts = {self.script(c) for c in word if c.isalpha()} & {*_SCRIPTS, "ARMENIAN"}
            if not scripts or scripts == {of_text} or word in SYMBOLS:
                continue
            sure = Counter(s for c in word if c not in self.shared and (s := self.script(c)) in _SCRIPTS)
            to = sure.most_common(1)[0][0] if sure else of_text
            table = self.by_script[to]
            if len(scripts) == 1 and not all(c in table for c in word if c.isalpha()):
                continue  # a foreign word in its own letters
            new = "".join(table.get(c, c) for c in word)
            out += [text[at : w.start()], new]
            at = w.end()
        return unicodedata.normalize("NFC", "".join(out) + text[at:])


def unify(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_name, pos, clean_value, is_off) for every non-null value of text or text-array columns.

    clean_value is the one form of all texts that look like the value, is_off tells whether the value was
    another. pos is the index in an array, from 0 and counting nulls, 0 elsewhere. The empty text is its own
    form. Repeated rows give theirs again, an empty table gives none.

    What comes to the driver is the alphabet: one row a code point, or composable letter with one mark, in use.
    """
    kinds = dict(df.dtypes)
    many = [kinds[f].startswith("array") for f in fields]
    values = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) if m else F.array(F.col(f)) for f, m in zip(fields, many)))
    rows = df.select(values.alias("v")).mapInArrow(_alphabet, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    counts = {r["s"]: r["n"] for r in rows}
    tables = rewriting(look_alikes(counts), counts)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(*tables)
        for batch in batches:
            keys, which, pos, clean, off = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for k, (name, is_array) in enumerate(zip(names, many)):
                for i, v in zip(ids, batch.column(k + 1).to_pylist()):
                    for p, x in enumerate(v or ()) if is_array else ((0, v),):
                        if x is not None:
                            new = rewrite(x)
                            keys.append(i)
                            which.append(name)
                            pos.append(p)
                            clean.append(new)
                            off.append(new != x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(which, pa.string()), pa.array(pos, pa.int32()), pa.array(clean, pa.string()), pa.array(off, pa.bool_())], names=[key, "field_name", "pos", "clean_value", "is_off"])

    return df.select(F.col(key).cast("long").alias(key), *fields).mapInArrow(run, f"`{key}` long, field_name string, pos int, clean_value string, is_off boolean")
