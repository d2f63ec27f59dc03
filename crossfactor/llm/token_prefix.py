"""Exact token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import table

#: How the byte-level vocabulary splits a text before any merge.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries after which a worker's cache starts anew.
CACHE = 1_000_000
#: Code points of a piece from which it is not cached, and of text that is split into pieces at once.
LONG, SLICE = 64, 1 << 20


_BYTE = (-1, b"", b"")


def _bytes_of_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next free letter from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter(dict):
    """Piece -> token count, filled on demand; ``prefixes`` has the count at every byte."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _bytes_of_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        pairs = [(raw[a], raw[b]) for a, b in spec["model"]["merges"]]
        self.pair = {p: i for i, p in enumerate(pairs)}
        #: token -> rank of the merge that makes it, and its two parts
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.tokens = [bytes([b]) for b in range(256)] + list(self.made)
        self.size = [len(t) for t in self.tokens]
        self.ends = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.ends.add_word(t.decode("latin-1"), i)
        self.ends.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.piece = regex.compile(PIECE)
        self.space = regex.compile(r"\p{White_Space}+").fullmatch
        self.fits: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Can token ``b`` come right after token ``a``?

        Yes unless a merge across the border comes before one of those that make the two. Those are undone from the last
        to the first; at each stage the pair at the border must not merge earlier (at equal rank, the left one is first).
        """
        x, y, limit, pair, made = self.tokens[a], self.tokens[b], 1 << 60, self.pair, self.made
        while True:
            if pair.get((x, y), 1 << 60) < limit:
                return False
            (rx, _, x2), (ry, y2, _) = made.get(x, _BYTE), made.get(y, _BYTE)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, x = rx, x2
            else:
                limit, y = ry + 1, y2

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece.

        The encoding of a prefix is that of a shorter prefix and one last token, and just one token that ends here may
        follow the last token of the prefix before it. The automaton lists the tokens that end at each byte.
        """
        count, last, size, fits = [0], [-1], self.size, self.fits
        for end, token in self.ends.iter(data.decode("latin-1")):
            if end < len(count) - 1:
                continue  # this prefix has its last token
            start = end + 1 - size[token]
            before = last[start]
            if before >= 0:
                key = before << 20 | token
                fit = fits.get(key)
                if fit is None:
                    if len(fits) > CACHE:
                        fits.clear()
                    fit = fits[key] = self.follows(before, token)
                if not fit:
                    continue
            count.append(count[start] + 1)
            last.append(token)
        return count

    def __missing__(self, piece: str) -> int:
        n = self.prefixes(piece.encode())[-1]
        if len(piece) < LONG:
            if len(self) > CACHE:
                self.clear()
            self[piece] = n
        return n

    def runs(self, text: str):
        """The text's parts between special tokens, and each special token as ``None``."""
        if not self.split or not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for m in self.split.finditer(text):
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]

    def slices(self, run: str):
        """Pieces of a run, in lists of bounded length."""
        at = 0
        while len(run) - at > SLICE:
            got = [m.span() for m in self.piece.finditer(run, at, at + SLICE + 256)]
            keep = [s for s in got if s[1] < at + SLICE] or got[:1]
            if len(keep) == 1 and keep[0][1] >= at + SLICE:
                keep = [self.piece.match(run, at).span()]  # one piece longer than a slice
            yield [run[a:b] for a, b in keep]
            at = keep[-1][1]
        yield self.piece.findall(run, at)

    def count(self, text: str) -> int:
        n, get = 0, self.__getitem__
        for run in self.runs(text):
            n += 1 if run is None else sum(sum(map(get, pieces)) for pieces in self.slices(run))
        return n

    def at_prefixes(self, text: str) -> np.ndarray:
        """Exact token count of ``text[:i]`` for every ``i`` from 0 to its length.

        Inside a piece the counts are those of the piece's own prefixes, but for the places where a cut changes the
        split itself: inside a contraction, after the space that opens a piece, and inside a special token.
        """
        out, n, done = np.zeros(len(text) + 1, np.int64), 0, 0
        for run in self.runs(text):
            if run is None:
                name = self.split.match(text, done).group()
                own = self._own(text[max(0, done - 1) : done], name)
                out[done + 1 : done + len(name)] = [n + x for x in own]
                n, done = n + 1, done + len(name)
                out[done] = n
                continue
            before = ""
            for pieces in self.slices(run):
                for p in pieces:
                    out[done + 1 : done + len(p) + 1] = [n + x for x in self._inside(before, p)]
                    n, done, before = n + self[p], done + len(p), p
        return self._cut_specials(text, out)

    def _inside(self, before: str, piece: str) -> list[int]:
        data, at, cuts = piece.encode(), 0, []
        for c in piece:
            at += len(c.encode())
            cuts.append(at)
        counts = self.prefixes(data)
        out = [counts[c] for c in cuts]
        if piece[0] == "'" and len(piece) > 2 and piece[1].isalpha():
            out[1] = self["'"] + self[piece[1]]
        if before and self.space(before) and self.space(piece[0]):
            # a text that ends here ends in one longer run of white space
            out[0] = self[before + piece[0]] - self[before]
        return out

    def _own(self, before: str, name: str) -> list[int]:
        return [self.count(name[:i]) for i in range(1, len(name))]

    def _cut_specials(self, text: str, out: np.ndarray) -> np.ndarray:
        """Re-counts prefixes that end inside a special token together with the piece before it."""
        if not self.split:
            return out
        for m in self.split.finditer(text):
            back = m.start()
            while back > 0 and m.start() - back < 256 and not (text[back].isspace() and not text[back - 1].isspace()):
                back -= 1
            for i in range(m.start() + 1, m.end()):
                out[i] = out[back] + self.count(text[back:i])
        return out

    def longest_prefix(self, text: str, limit: int) -> int:
        """Code points of the longest run of whole pieces (or special tokens) from the start with at most ``limit`` tokens,
        and then as much of the next piece as fits; a binary search in the stored counts."""
        n, done = 0, 0
        for run in self.runs(text):
            if run is None:
                if n + 1 > limit:
                    return done
                n, done = n + 1, done + len(self.split.match(text, done).group())
                continue
            for pieces in self.slices(run):
                total = list(accumulate(map(self.__getitem__, pieces), initial=n))
                k = bisect_right(total, limit) - 1
                done += sum(map(len, pieces[:k]))
                if k < len(pieces):
                    inside = self._inside("", pieces[k])
                    return done + max((i + 1 for i, x in enumerate(inside) if total[k] + x <= limit), default=0)
                n = total[-1]
        return done


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    """One per worker process. A bare name is looked up among the installed public vocabularies."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Counter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, keep_chars)``, one row per row of ``docs``.

    Counts are those of the vocabulary's own library without added tokens; special tokens inside a text count one.
    ``keep_chars`` is how many code points can stay when the text is cut to ``limit`` tokens. Null and empty texts
    have no bytes and no tokens. Ids may be null or repeat. Other columns are not read.
    """

    @F.pandas_udf("n_tokens long, keep_chars long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        c, rows = counter(vocabulary), []
        for t in texts:
            t = t or ""
            n = c.count(t)
            rows.append((n, len(t) if n <= limit else c.longest_prefix(t, limit)))
        return pd.DataFrame(rows, columns=["n_tokens", "keep_chars"], dtype="int64")

    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), measure(F.col(text)).alias("m"))
    return out.select("doc_id", "n_bytes", "m.n_tokens", (F.col("m.n_tokens") > limit).alias("over_limit"), "m.keep_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
