"""Exact token counts at every prefix of a text, for a byte-pair vocabulary of sentencepiece.

The pieces of a prefix are found by dynamic programming: if t is the last piece of the encoding of
the first i characters, then the pieces before it are the encoding of the first i - len(t), so

    count[i] = count[i - len(last[i])] + 1,

and last[i] is the longest piece that ends at i and may follow last[i - len] (two pieces may stand
side by side if encoding their joint text gives just these two). The table answers how many tokens
any prefix has, and where a budget of tokens ends, without encoding again.

No piece of the vocabulary goes on after a word's end (a space is part of the piece that follows
it), so a text is cut into segments, a run of spaces with the word after it, whose tables don't
depend on their neighbours. A task fills the table of each different segment once and adds the
counts up over the text; the same tables say how many characters fit a budget. Texts are never
encoded: the library only gives the vocabulary with its ranks, and the tests hold the counts against
its own. A model with pieces across words or line ends is an error.

Nulls and empty texts have 0 tokens. Whole texts are counted, a long one some segments at a time; a
word of any length is one segment, whose table takes time in proportion to its length. Repeated rows
are counted like others, and an empty table gives no rows. A column of the input with the name of a
result is replaced by it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithos.llm.common import chunks

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: A run of spaces with what follows up to the next one; a line end stands alone, as no piece has one.
SEGMENT = re.compile("\n|▁*[^▁\n]+|▁+")
#: Segments that a task keeps tables of.
KEPT = 700_000
#: Characters of text cut into segments at once, and segments of a longer text.
CHUNK = 1 << 20
SEGMENTS = 1 << 17


class PrefixCounts:
    """Tables of prefix counts under one sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.rank = {}
        for i in range(m.vocab_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                self.rank[m.id_to_piece(i)] = m.get_score(i)
        # the lengths, longest first, of the pieces that end with these two characters, or this one at the beginning of a text
        ends: dict[str, set[int]] = {}
        for p in self.rank:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.sizes = {k: (*sorted(v, reverse=True), *(() if 1 in v else (1,))) for k, v in ends.items()}
        self.alone = (1,)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("the model has pieces across words or lines")
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits = lru_cache(1 << 20)(self._fits)
        self.totals: dict[str, int] = {}
        # the library puts a space before a text and drops none: an empty text shows neither
        self.prefix = m.encode("a", out_type=str)[0].startswith(SPACE)

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece joins; the best pair goes first, the leftmost of equals."""
        if piece not in self.halves:
            parts, joined = list(piece), None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
                at = ranks.index(max(ranks))
                if ranks[at] == -np.inf:
                    joined = None
                    break
                joined = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = joined
        return self.halves[piece]

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at an edge of a piece while it is built, from the last to the first, and the rank of the merge that ends it."""
        out, end = [], -np.inf
        while True:
            out.append((piece, end))
            halves = self.split(piece)
            if halves is None:
                return out
            piece, end = halves[side], self.rank[piece]

    def _fits(self, left: str, right: str) -> bool:
        """No merge across the border comes before those that build the two pieces."""
        inner = self.edge(right, 0)
        for a, a_end in self.edge(left, 1):
            for b, b_end in inner:
                r = self.rank.get(a + b)
                if r is not None and r > a_end and r >= b_end:
                    return False
        return True

    def extend(self, segment: str, i: int, count: list[int], last: list[str]) -> None:
        """Entry i of a table that holds the entries before it."""
        rank, fits = self.rank, self.fits
        for size in self.sizes.get(segment[i - 2 : i] if i > 1 else segment[:1], self.alone):
            if size > i:
                continue
            piece = segment[i - size : i]
            if piece in rank:
                before = last[i - size]
                if before in rank and not fits(before, piece):
                    continue
                count.append(count[i - size] + 1)
                last.append(piece)
                return
        # characters outside the vocabulary become the bytes of their UTF-8 form
        count.append(count[i - 1] + len(segment[i - 1].encode()))
        last.append(segment[i - 1])

    def table(self, segment: str) -> list[int]:
        """count[i]: the tokens of the first i characters of a segment."""
        count, last = [0], [""]
        for i in range(1, len(segment) + 1):
            self.extend(segment, i, count, last)
        return count

    def tables(self, segments: list[str]):
        """The last entry of the table of each segment, in order; a prefix in common with the segment before keeps its entries."""
        before, count, last = "", [0], [""]
        for s in segments:
            same, most = 0, min(len(s), len(before))
            while same < most and s[same] == before[same]:
                same += 1
            del count[same + 1 :], last[same + 1 :]
            for i in range(same + 1, len(s) + 1):
                self.extend(s, i, count, last)
            before = s
            yield count[-1]

    def plain(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(self.plain(text))

    def learn(self, segments) -> None:
        """Fill the tables of new segments and keep their last entries."""
        new = sorted(s for s in segments if s not in self.totals)
        if len(self.totals) + len(new) > KEPT:
            self.totals.clear()
            new = sorted(segments)
        self.totals.update(zip(new, self.tables(new)))

    def counts(self, texts: list[str], limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each whole text, and the most characters of it whose tokens are within the limit."""
        n, fits = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts], np.int64)
        sizes = np.cumsum([0, *map(len, texts)])
        for i, j in chunks(sizes, CHUNK):
            if j - i == 1:
                found = (m.group() for m in SEGMENT.finditer(self.plain(texts[i])))
                rows = ((i, part) for part in iter(lambda: list(islice(found, SEGMENTS)), []))  # noqa: B023
            else:
                parts = [self.segments(t) for t in texts[i:j]]
                self.learn(set().union(*parts))
                rows = zip(range(i, j), parts)
            at = 0
            for k, part in rows:
                if j - i == 1:
                    self.learn(set(part))
                more = list(map(self.totals.__getitem__, part))
                total = sum(more)
                if n[k] <= limit < n[k] + total:
                    fits[k] = at + self._within(part, more, limit - int(n[k])) - (self.prefix and (at > 0 or bool(part)))
                    fits[k] = max(fits[k], 0)
                n[k] += total
                at = at + sum(map(len, part)) if j - i == 1 else 0
        return n, fits

    def _within(self, part: list[str], counts: list[int], budget: int) -> int:
        """The most characters of segments, which together are over the budget, that are within it."""
        k = int(np.searchsorted(np.cumsum(counts), budget, "right"))
        table = np.array(self.table(part[k])) + sum(counts[:k])
        return sum(map(len, part[:k])) + int(np.flatnonzero(table <= budget)[-1])

    def prefix_table(self, text: str) -> np.ndarray:
        """count[i]: the tokens of the first i characters of a text, for every i."""
        out, at = [0], 0
        for k, segment in enumerate(self.segments(text)):
            t = self.table(segment)
            out.extend(at + c for c in t[2 if k == 0 and self.prefix else 1 :])
            at += t[-1]
        return np.array(out, np.int64)


def within(table: np.ndarray, budget: int) -> int:
    """The most characters whose tokens fit the budget, from a text's prefix table."""
    return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(4)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit and n_chars_within (the longest prefix within the limit); path names the model on every executor."""
    made = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType(), "n_chars_within": T.LongType()}
    kept = [c for c in docs.columns if c not in made]
    out = T.StructType([docs.schema[c] for c in kept if c != text] + [T.StructField(c, t) for c, t in made.items()])

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            n, fits = c.counts(texts, limit)
            cols = [b.column(x) for x in kept if x != text]
            cols += [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit), pa.array(fits)]
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return docs.select(*kept).mapInArrow(run, out)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, model_path())
