"""Texts above a size cut into pieces, at natural boundaries, with an overlap of a set size.

Dynamic programming over boundary positions: a cut costs by its kind, a piece by how far it is from the even size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import TOKENIZER, clean, load

KINDS = ("heading", "paragraph", "line", "sentence", "word", "token")
#: What a cut of each kind costs, and a piece that is off the even size by the whole limit.
PENALTY = np.array([0.0, 0.3, 0.8, 1.2, 6.0, 20.0])
UNEVEN = 4.0
#: Boundaries whose pieces are weighed at a time.
BLOCK = 64

# Words that end in a point without ending a sentence.
ABBREVIATIONS = ("p. ex", "cf", "etc", "anc", "env", "fig", "no", "vol", "art", "av", "apr", "chap", "éd", "m", "mm", "mme", "mlle", "dr", "st", "ste", "mr", "mrs", "vs", "e.g", "i.e", "z. b", "bzw", "usw", "nr", "ca", "approx")

_LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"


class Splitter:
    """Pieces of texts in the tokens of one coder; made on each executor."""

    def __init__(self, coder) -> None:
        import regex

        self.coder = coder
        self.size = np.zeros(coder.n_vocab, np.int64)
        for token, i in coder._mergeable_ranks.items():
            self.size[i] = len(token)
        self.lines = regex.compile(rf"[^\S\r\n\x0b\x0c\x85\u2028\u2029]*({_LINE})(\s*{_LINE})?")
        # a heading begins there: marked by signs, by its number, or underlined
        self.heading = regex.compile(rf"\s*(?:#{{1,6}}\s|={{2,}}\s*\w|\d+(?:\.\d+)*[.)]\s+\p{{Lu}}[^.\r\n]{{0,60}}(?:{_LINE}|$)|[^\r\n]{{1,60}}{_LINE}[=\-]{{3,}})")
        self.ends = regex.compile(r"(?:([.!?…]+)[\"'»”’)\]]*(\s+)|[。！？]+[」』）]*())(?=\S)")
        self.words = regex.compile(r"(?r)(?<![\p{L}\p{N}.])[\p{L}\p{N}.]+(?: ex| b)?")
        self.short = frozenset(ABBREVIATIONS)
        # between a letter and a blank before a letter the tokenizer parts every text, whatever stands around
        self.first_seam, self.last_seam = (regex.compile(way + r"(?<=\p{L}) (?=\p{L})") for way in ("", "(?r)"))

    def boundaries(self, text: str) -> list[tuple[int, int, int]]:
        """(from, to, kind): spans of characters in which a cut is at a boundary of that kind."""
        out = []
        heading, words = self.heading.match, self.words.search
        for m in self.lines.finditer(text):
            start, end = m.span()
            out.append((start, end, 0 if heading(text, end) else 1 if m.start(2) >= 0 else 2))
        for m in self.ends.finditer(text):
            end = m.end()
            at, to = m.span(1)
            if to - at == 1 and text[at] == ".":
                if text[end].islower():
                    continue
                before = words(text, 0, at)
                word = before.group().lower() if before else ""
                if word in self.short or (len(word) == 1 and word.isalpha()) or (word[-2:-1] == "." and word[-1:].isalpha()):
                    continue
            gap = m.start(2)
            out.append((gap if gap >= 0 else end, end, 3))
        return out

    def read(self, text: str) -> tuple:
        """The text's tokens: count, bytes, byte places, kinds of boundary, places between characters and between words."""
        ids = np.array(self.coder.encode_ordinary(text), np.int64)
        raw = text.encode("utf-8")
        return (len(ids), raw, np.concatenate([[0], np.cumsum(self.size[ids])]), text)

    def places(self, read: tuple) -> tuple:
        n, raw, at, text = read
        lead = np.frombuffer(raw + b" ", np.uint8)[at]
        whole = (lead & 0xC0) != 0x80
        kind = np.full(n + 1, 9)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bytes_at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        spans = np.array(self.boundaries(text), np.int64).reshape(-1, 3)
        t = np.searchsorted(at, bytes_at[spans[:, 1]], side="right") - 1
        ok = (at[t] >= bytes_at[spans[:, 0]]) & whole[t]
        np.minimum.at(kind, t[ok], spans[ok, 2])
        # a word begins or ends where a blank or a sign follows
        signs = np.ones(256, bool)
        signs[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", np.uint8)] = False
        signs[128:] = False
        signs[0xE2] = True  # general punctuation, arrows and other signs
        return whole, kind, signs[lead]

    def cuts(self, n: int, places: tuple, limit: int, overlap: int, banned: dict[int, set[int]] | None = None, finest: bool = False) -> list[tuple[int, int, int]] | None:
        """(start, end, kind of the cut at its end or -1) of each piece, in tokens; none where there is no way.

        No piece goes from a start to an end that `banned` names, by end; `finest` lets in cuts between all tokens.
        """
        if n <= limit and not banned:
            return [(0, n, -1)]
        whole, kind, between = places
        kind = kind.copy()
        every = np.arange(n + 1)
        # where the next piece starts: so many tokens back, or up to three more to a place between characters
        start = np.maximum.accumulate(np.where(whole, every, 0))[np.maximum(every - overlap, 0)]
        usable = whole & (every - start < limit) & (every > start)
        usable[0] = usable[n] = True
        chosen = usable & (kind < 9)
        chosen[0] = chosen[n] = True
        step = 0 if finest else max(1, limit - overlap - 3)
        for finer, what in ((4, usable & between), (5, usable)):
            at = np.flatnonzero(chosen)
            for k in np.flatnonzero(np.diff(at) > step):  # no boundary within reach: finer ones are let in here
                more = at[k] + 1 + np.flatnonzero(what[at[k] + 1 : at[k + 1]])
                chosen[more] = True
                kind[more] = np.minimum(kind[more], finer)
        c = np.flatnonzero(chosen)
        begin = start[c].copy()
        begin[0] = 0
        penalty = np.where(kind[c] < 9, PENALTY[np.minimum(kind[c], 5)], 0.0) + 0.5
        penalty[-1] = 0.5
        count = max(1, -(-(n - overlap) // max(1, limit - overlap)))
        even = (n + (count - 1) * overlap) / count
        cost, last = np.full(len(c), np.inf), np.full(len(c), -1)
        cost[0] = 0
        first = np.searchsorted(begin, c - limit, side="left").tolist()  # begin never falls
        ends = (c - even) / limit
        scaled = begin / limit
        for j0 in range(1, len(c), BLOCK):
            j1, low = min(len(c), j0 + BLOCK), first[j0]
            uneven = UNEVEN * np.square(ends[j0:j1, None] - scaled[None, low:j1])  # of every piece that ends in this block
            for j in range(j0, j1):
                lo = first[j]
                if lo < j:
                    total = cost[lo:j] + uneven[j - j0, lo - low : j - low]
                    if banned and int(c[j]) in banned:
                        total[np.isin(begin[lo:j], list(banned[int(c[j])]))] = np.inf
                    b = int(total.argmin())
                    cost[j], last[j] = total[b] + penalty[j], lo + b
        if not np.isfinite(cost[-1]):
            return None
        out, j = [], len(c) - 1
        while j > 0:
            i = int(last[j])
            out.append((int(begin[i]), int(c[j]), int(kind[c[j]]) if j < len(c) - 1 else -1))
            j = i
        return out[::-1]

    def own_size(self, piece: str, raw_from: int, read: tuple) -> int:
        """How many tokens a piece has on its own: those of its ends are counted anew, between the first and the last seam they are
        those of the whole text."""
        at = read[2]
        head = self.first_seam.search(piece)
        if head is None:
            return len(self.coder.encode_ordinary(piece))
        tail = self.last_seam.search(piece)
        lo = raw_from + len(piece[: head.start()].encode())
        hi = raw_from + len(piece[: tail.start()].encode())
        i, j = np.searchsorted(at, (lo, hi))
        return len(self.coder.encode_ordinary(piece[: head.start()])) + int(j - i) + len(self.coder.encode_ordinary(piece[tail.start() :]))

    def __call__(self, text: str, limits: Sequence[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, str, int]]:
        """(use, start, end, kind, text, tokens of that text) of all pieces for all limits."""
        read = self.read(text)
        n, raw, at, _ = read
        places = None
        for name, limit, overlap in limits:
            if n <= limit:
                yield name, 0, n, -1, text, n
                continue
            places = places or self.places(read)
            yield from ((name, *x) for x in self.within(n, raw, at, read, places, limit, overlap))

    def within(self, n: int, raw: bytes, at: np.ndarray, read: tuple, places: tuple, limit: int, overlap: int) -> list[tuple[int, int, int, str, int]]:
        # a piece on its own may part into more tokens than within its text: such a piece is banned, the others stay possible
        seen: dict[tuple[int, int], tuple[str, int]] = {}
        for back in (overlap, 0):
            for finest in (False, True):
                banned: dict[int, set[int]] = {}
                while (got := self.cuts(n, places, limit, back, banned, finest)) is not None:
                    over = False
                    for a, b, _ in got:
                        if (a, b) not in seen:
                            piece = raw[at[a] : at[b]].decode("utf-8")
                            seen[a, b] = piece, self.own_size(piece, int(at[a]), read)
                        if seen[a, b][1] > limit:
                            banned.setdefault(b, set()).add(a)
                            over = True
                    if not over:
                        return [(a, b, k, *seen[a, b]) for a, b, k in got]
        raise ValueError(f"a limit of {limit} tokens holds no character")


def split_texts(df: DataFrame, key: str, text: str, limits: Sequence[tuple[str, int, int]], path: str = TOKENIZER) -> DataFrame:
    """(use_name, key, piece_no, start_token, end_token, n_tokens, cut_kind, piece_text): the pieces of every text.

    limits: (use_name, max_tokens, overlap_tokens), the overlap less than half the limit. A text within a limit is one piece. Pieces
    of a larger one are of max_tokens at most, counted as the piece alone; each starts overlap_tokens before the end of the one
    before it, or up to three more where that would be inside a character, or without overlap in a text that can't be cut
    otherwise. cut_kind names the boundary at a piece's end:
    heading, paragraph, line, sentence, word, token, or 'end'. Words, and single tokens, are cut only where no other
    boundary is within reach. Null and empty texts have no pieces. Whole texts are read, however long.
    """
    for name, size, overlap in limits:
        if not 0 <= 2 * overlap < size or size < 16:
            raise ValueError(f"{name}: the overlap must be less than half of a limit of at least 16")
    limits = list(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(load(path))
        fields = ("use_name", "key", "piece_no", "start_token", "end_token", "n_tokens", "cut_kind", "piece_text")
        types = (pa.string(), None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        out: dict[str, list] = {f: [] for f in fields}
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            make = lambda kind=kind: pa.RecordBatch.from_arrays([pa.array(out[f], t or kind) for f, t in zip(fields, types)], names=[key if f == "key" else f for f in fields])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                use, i = None, 0
                for name, a, b, cut_kind, piece, n in split(clean(t), limits):
                    use, i = name, i + 1 if name == use else 0
                    for f, v in zip(fields, (name, k, i, a, b, n, KINDS[cut_kind] if cut_kind >= 0 else "end", piece)):
                        out[f].append(v)
                    held += len(piece)
                if held > 4_000_000:
                    yield make()
                    out = {f: [] for f in fields}
                    held = 0
            if out["key"]:
                yield make()
                out = {f: [] for f in fields}
                held = 0

    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"use_name string, `{key}` {kind}, piece_no int, start_token int, end_token int, n_tokens int, cut_kind string, piece_text string")
