"""Hierarchical residual packing of token sequences: local best fit, then a tree of merges of underfull bins.

Documents become pieces of at most `size` tokens (only longer documents are cut). Groups of pieces
are packed best-fit, largest first. A bin that is nearly full is finished; the underfull ones are items
of the next round, in which the items of `fan` groups make one group and are packed best-fit again, and
so on until one group is left.

What keeps the groups small is a count of open bins by fill, `size` numbers on the driver: best fit by
counts says how many bins of each fill would stay alone if all open bins were packed together, and as
many are finished as they are. Best fit leaves a group at most one bin that is half full or less, and a
bin that will be merged needs such a one, so no more than two open bins for each group go up the tree:
a group of a later round has some 2 * fan items, whatever the corpus. Nothing is ever split, dropped or
padded, and a bin carries its pieces along, so no join of pieces is needed at the end.

Nulls and empty texts are documents of one token, the end mark. A repeated row is packed as often
as it comes. Ties are broken by (length, id, piece). An empty table gives no rows. A column of the
input with the name of a result is replaced by it.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import chunks, materialize, utf8

TOKENIZER = "word_bpe_49k.json"
SIZE = 2048
END = 0
#: Items that one group packs, groups that one of the next round takes, and the room that a finished bin may leave.
GROUP = 40_000
FAN = 64
ROOM = 8
#: Words that a task keeps the ids of (some 45 bytes each); bytes of text handled at once.
KEPT = 1_000_000
CHUNK = 8 << 20
#: Words encoded in one text, and in one call.
TOGETHER = 500
AT_ONCE = 20_000
#: Signs at a word's end that are a token run of their own after a letter or digit; no special token ends with one.
TAIL = ".,;:!?*$&#%|)"
#: Letters below this one are no marks and are their own normal form; the byte-level pieces' characters for the bytes that aren't printable.
BEYOND = "\u0250"
PLAIN = "^[a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]+$"
LETTERS = {b: 256 + 33 + b - 127 for b in range(127, 161)} | {173: 256 + 67}
#: Whether a byte is one of those signs, a letter or digit; as how long a run of signs at a word's end is parted from it.
SIGN, ALNUM = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (TAIL, ascii_letters + digits))
LONGEST = 8


class WordIds:
    """Token ids of texts, from the ids of their words.

    The tokenizer drops white space and never joins what it parts, so the ids of a text are those
    of its words one after another; each different word is encoded once and kept as bytes. Arrays
    part the words and Arrow numbers the different ones, so that no text is handled word by word.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # a character of a byte-level piece is a byte; </w> marks the end of a run of letters, digits or signs
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(piece.removesuffix("</w>"))
        # runs of plain letters need no rules: the same model, each word a piece of its own
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        # words, their ids as bytes, and whether a word was met again since it was learned or last kept
        self.words, self.raw, self.again = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    @property
    def known(self) -> list[str]:
        return self.words.to_pylist()

    def numbers(self, words: pa.Array) -> pa.Array:
        """The place in self.words of each of some different words; new ones are put there before."""
        n = pc.index_in(words, value_set=self.words)
        met = n.drop_null().to_numpy()
        self.again[met] = True
        if n.null_count:
            new = words.filter(n.is_null())
            if len(self.words) + len(new) > KEPT:
                # words met again are kept, and if these are many, those of this text alone
                keep = self.again
                if keep.sum() > KEPT // 2:
                    keep = np.zeros(len(keep), bool)
                keep[met] = True
                self.words, self.raw, self.again = self.words.filter(pa.array(keep)), self.raw.filter(pa.array(keep)), np.zeros(keep.sum(), bool)
            plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
            plain[~plain] = [is_plain(w) for w in new.filter(pa.array(~plain)).to_pylist()]
            for some, tokenizer in ((plain, self.plain), (~plain, self.tokenizer)):
                some = new.filter(pa.array(some))
                for i in range(0, len(some), AT_ONCE):
                    group = some.slice(i, AT_ONCE)
                    self.words, self.raw = pa.concat_arrays([self.words, group]), pa.concat_arrays([self.raw, self.encode(group.to_pylist(), tokenizer)])
            self.again = np.append(self.again, np.zeros(len(self.words) - len(self.again), bool))
            n = pc.index_in(words, value_set=self.words)
        return n

    def encode(self, new: list[str], tokenizer) -> pa.Array:
        """Words are encoded many at a time; the bytes that each id stands for tell where a word's ids end."""
        texts = [" ".join(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)]
        lengths = [len(w) for w in " ".join(texts).lower().encode().split(b" ")]
        if tokenizer is self.plain:
            texts = [t.encode().decode("latin-1").translate(LETTERS) for t in texts]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        at, ends = np.cumsum(self.width[ids]), np.cumsum(lengths)
        cut = np.searchsorted(at, ends, "right")
        if not (len(ends) == len(new) and (np.append(0, at)[cut] == ends).all() and len(at) and at[-1] == ends[-1]):
            # a special token or a change of length by normalisation
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(np.append(0, 4 * cut)), pa.py_buffer(ids)])

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        data, off = utf8(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        out = []
        for i, j in chunks(off, CHUNK):
            words, before = parted(data[off[i] : off[j]], off[i : j + 1] - off[i])
            # the ids of all words, taken from those of the different ones, are those of the texts one after another
            words = words.dictionary_encode()
            numbers = self.numbers(words.dictionary)
            got = self.raw.take(numbers).take(words.indices)
            at = np.frombuffer(got.buffers()[1], np.int64)[before].tolist() if len(got) else [0] * len(before)
            raw = memoryview(got.buffers()[2] or b"")
            out += [bytes(raw[x:y]) for x, y in zip(at, at[1:])]
        return out


def parted(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (UTF-8, and where each begins and the last ends) one after another, and how many come before each text and in all.

    A word of plain letters is in lower case. Signs at the end of a word are one of their own where the tokenizer
    parts them whatever they are: the many forms of a stem are one then.
    """
    begin = np.zeros(len(data) + 1, bool)
    begin[off] = True  # of a text; words don't cross it
    dark = ~((data == 32) | (data - np.uint8(9) < 5))
    gap = begin.copy()
    gap[1:] |= ~np.append(dark[1:], False)  # after a byte: no word goes on
    first = np.flatnonzero(dark & np.append(True, ~dark[:-1] | begin[1:-1]))
    if not len(first):
        return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    last = np.flatnonzero(dark & gap[1:])
    # each word's last signs, looked for as far as LONGEST
    signed = np.flatnonzero(SIGN[data[last]])
    lo, at, found = first[signed], last[signed], []
    for _ in range(LONGEST):
        at = at - 1
        inside = at >= lo
        more = SIGN[data[at]] & inside
        found.append(at[inside & ~more])
        lo, at = lo[more], at[more]
    at = np.concatenate(found)
    # they follow a letter or digit of ASCII or of two bytes below U+0240; a capital i with a dot ends with a mark in lower case
    tail, lead = data[at], data[at - 1]
    latin = (lead == 0xC3) & (tail != 0x97) & (tail != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8) & ~((lead == 0xC4) & (tail == 0xB0))
    cut = at[ALNUM[tail] | latin & (tail >= 0x80) & (tail < 0xC0)] + 1
    first, end = (np.sort(np.concatenate([x, cut]), kind="stable") for x in (first, last + 1))
    before = np.searchsorted(first, off)
    # without white space
    text = data[dark]
    at = np.append(0, np.cumsum(end - first))
    # lower case, where all of a word is letters of ASCII or of two bytes up to U+00FF
    other = np.flatnonzero((text | 32) - np.uint8(97) >= 26)
    byte = text[other]
    latin = (text[other - 1] == 0xC3) & (byte >= 0x80) & (byte < 0xC0) & (byte != 0x97) & (byte != 0xB7)
    odd = other[~(latin | (byte == 0xC3) & np.append(latin[1:], False))]
    plain = np.ones(len(first), bool)
    plain[np.searchsorted(at, odd, "right") - 1] = False
    for capital in (np.flatnonzero(text - np.uint8(65) < 26), other[latin & (byte < 0x9F)]):
        text[capital[plain[np.searchsorted(at, capital, "right") - 1]]] += 32
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(text)), before


def is_plain(word: str) -> bool:
    """Lower-case letters alone, which the tokenizer neither changes nor parts."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < BEYOND)


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with with_ids the ids (bytes)."""
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    out = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        w = word_ids(path)
        for b in batches:
            ids = b.column(id_col).to_pylist()
            rows = [[] for _ in out.names]
            for d, raw in zip(ids, w.ids(b.column(text))):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for to, v in zip(rows, (d, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        to.append(v)
            types = [b.schema.field(id_col).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], out.names)

    return docs.select(id_col, text).mapInArrow(run, out)


def best_fit(sizes: list[int], size: int = SIZE) -> list[list[int]]:
    """The bins of a list of sizes: largest first, each into the fullest bin that it fits."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fitting = there >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there ^= 1 << r
            bins[b].append(i)
        else:
            r, b = size, len(bins)
            bins.append([i])
        if r - s:
            room[r - s].append(b)
            there |= 1 << (r - s)
    return bins


def match(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """best_fit() by counts: (kinds of bins as (fill, times) with the largest first, number of such bins) for numbers of items by fill."""
    room: list[list] = [[] for _ in range(size + 1)]
    there = 0  # bit r: some kind of bin has room r
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            fitting = there >> s
            if fitting:
                r = s + (fitting & -fitting).bit_length() - 1
                kind, n = room[r].pop()
            else:
                r, kind, n = size, [], left
            most = r // s
            if left >= most:
                times, took = most, min(n, left // most)
            else:
                times, took = left, 1
            left -= times * took
            if kind and n > took:
                room[r].append((kind, n - took))
            elif not room[r]:
                there &= ~(1 << r)
            room[r - times * s].append(([*kind, (s, times)], took))
            there |= 1 << (r - times * s)
    return [x for r in room for x in r]


def alone(counts: dict[int, int], size: int = SIZE) -> dict[int, int]:
    """How many bins of each fill stay alone when all are packed best-fit."""
    out: dict[int, int] = {}
    for kind, n in match(counts, size):
        if len(kind) == 1 and kind[0][1] == 1:
            out[kind[0][0]] = out.get(kind[0][0], 0) + n
    return out


def pack(items: DataFrame, size: int = SIZE, group: int = GROUP, fan: int = FAN, room: int = ROOM) -> DataFrame:
    """items (columns of pieces()) with sequence_id and offset."""
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = items.select(*names)
    groups = max(1, math.ceil(items.count() / group))
    item = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in items.schema)
    schema = f"__group int, __bin long, __done boolean, __fill long, __rank long, __items array<struct<{item}>>"
    # the groups are dealt by a hash of the piece, so each holds sizes of every kind; with its row's number, so that repeated rows don't meet in one
    here = items.select(F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("__group"), F.col("length").alias("__fill"), F.array(F.struct(*names)).alias("__items"))
    bins, level = None, 0
    while True:
        out = materialize(here.groupBy("__group").applyInArrow(_packer(size, room, groups == 1, names, level), schema))
        done = out.where("__done").select("__bin", "__items")
        bins = done if bins is None else bins.unionByName(done)
        if groups == 1:
            break
        rest = out.where("NOT __done")
        counts = materialize(rest.groupBy("__fill", "__group").agg(F.count("*").alias("n")))
        total = {r["__fill"]: r["n"] for r in counts.groupBy("__fill").agg(F.sum("n").alias("n")).collect()}  # a number for each fill
        if not total:
            break
        single = alone(total, size)
        before = F.coalesce(F.sum("n").over(Window.partitionBy("__fill").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        known = rest.join(counts.select("__fill", "__group", before.alias("__before")), ["__fill", "__group"])
        # the first so many bins of a fill, counted over the groups, stay as they are
        stay = rest.sparkSession.createDataFrame(list(single.items()), "__fill long, __stay long")
        known = known.join(F.broadcast(stay), "__fill", "left")
        stays = F.col("__before") + F.col("__rank") < F.coalesce("__stay", F.lit(0))
        known = known.select((F.col("__group") / fan).cast("int").alias("__group"), "__bin", "__fill", "__items", stays.alias("__single"))
        bins = bins.unionByName(known.where("__single").select("__bin", "__items"))
        if single == total:
            break
        here = known.where("NOT __single").select("__group", "__fill", "__items")
        groups, level = math.ceil(groups / fan), level + 1
    # pieces of a bin stand in the order of the array: the offset is the lengths before it
    placed = bins.select(F.col("__bin").alias("sequence_id"), F.posexplode("__items").alias("__at", "__item"), F.col("__items.length").alias("__lengths"))
    offset = F.aggregate(F.slice("__lengths", F.lit(1), F.col("__at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*[F.col(f"__item.{c}").alias(c) for c in names], "sequence_id", offset.alias("offset"))


def _packer(size: int, room: int, last: bool, names: list[str], level: int = 0):
    def run(key, table):
        group = key[0].as_py()
        items = table["__items"].combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False))])
        flat = items.flatten()
        fill = table["__fill"].to_numpy()
        first = pc.struct_field(flat, names[0]).take(pa.array(starts[:-1])) if len(fill) else None
        # a fixed order whatever the order of arrival: length, then the first piece's values
        keys = {"f": pa.array(-fill), "d": first} | {c: pc.struct_field(flat, c).take(pa.array(starts[:-1])) for c in ("piece", "start", "ids_crc32") if c in names}
        order = pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys]).to_numpy()
        bins = best_fit(fill[order].tolist(), size)
        took, lists, fills = [], [0], []
        for b in bins:
            for i in b:
                k = order[i]
                took.append(np.arange(starts[k], starts[k + 1]))
            lists.append(lists[-1] + sum(int(starts[order[i] + 1] - starts[order[i]]) for i in b))
            fills.append(int(sum(fill[order[i]] for i in b)))
        flat = flat.take(pa.array(np.concatenate(took) if took else np.zeros(0, np.int64)))
        full = np.array(fills, np.int64)
        done = np.ones(len(full), bool) if last else full >= size - room
        ids = (np.int64(level) << 58) | (np.int64(group) << 34) | np.arange(len(full), dtype=np.int64)
        # the number of each bin among the open ones of its fill
        rank = np.zeros(len(full), np.int64)
        open_ = np.flatnonzero(~done)
        open_ = open_[np.argsort(full[open_], kind="stable")]
        f = full[open_]
        rank[open_] = np.arange(len(f)) - np.searchsorted(f, f)
        return pa.table({"__group": pa.array(np.full(len(full), group, np.int32)), "__bin": pa.array(ids), "__done": pa.array(done), "__fill": pa.array(full), "__rank": pa.array(rank), "__items": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), flat)})

    return run


def op10_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = materialize(pieces(docs, tokenizer_path()))
    return pack(cut)
