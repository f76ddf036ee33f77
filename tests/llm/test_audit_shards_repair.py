"""Filter audit, sharding and conversation repair against brute-force versions, on rows that hold the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lithos.llm import conversation_repair, filter_audit, sharding
from lithos.llm.common import word_parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, size string, __text string"


def rows():
    r = random.Random(3)
    say = lambda n, k=400: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    t = [None, "", " \n ", "AB CD", "é # ü", say(250), say(250, 5), say(230) + " $5", "Ab" * 900, "日本 " * 300, say(40)]
    copies = [t[5]] * 40 + [""] * 9
    base = [(i * 2, x, [None, "", "a", "b"][i % 4], "p", "s", "t") for i, x in enumerate(t + copies + [say(60) for _ in range(60)])]
    return base + [base[5], base[5], (None, t[5], "a", "", "", ""), (None, None, None, "", "", ""), (None, None, None, "", "", ""), (4, t[7], "a", "", "", "")]


@pytest.fixture(scope="module")
def given():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, DOCS).repartition(5).cache()


def test_filter_audit(spark, docs, given):
    labels = [(2 * i, i % 2, i % 3 == 0) for i in range(60)] + [(10, 0, True), (10, 1, False), (None, 1, True), (12, None, None)]
    marks = spark.createDataFrame([(d, q, None if x is None else int(x)) for d, q, x in labels], "doc_id long, quality int, toxic int")
    least = {}
    for d, t, *_ in given:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    facts = []
    for d, t, source, *_ in given:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        facts.append((source or "", {k for k, v in fails.items() if v}, any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and y for x, _, y in labels if d is not None)))
    want = Counter()
    removed = Counter()
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for p in permutations("ABCDE"):
            for k, x in enumerate(p):
                alive = [f for f in mine if not f[1] & set(p[:k])]
                gone = [f for f in alive if x in f[1]]
                removed[part, x] += len(gone)
                want[part, "".join(p), k + 1, len(alive) - len(gone), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)] += 1
    want = Counter({(*key, removed[key[0], key[1][key[2] - 1]]): n for key, n in want.items()})
    got = filter_audit.audit(docs, marks)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_many_parts_are_passed_on_in_time(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3)
    flags = [(f"p{i % 11}", i * 7 % 32, i % 5 == 0, i % 3 == 0) for i in range(500)]
    got = filter_audit.step_counts(spark.createDataFrame(flags, "part string, fails int, good boolean, toxic boolean").repartition(3))
    for r in got.where("part in ('p0', 'p7')").collect():
        mine = [f for f in flags if f[0] == r.part]
        assert r.removed == sum(not f[1] & r.before and f[1] >> r.filter & 1 for f in mine)
        assert r.kept == sum(not f[1] & (r.before | 1 << r.filter) for f in mine)
        assert r.toxic_lost == sum(bool(not f[1] & r.before and f[1] >> r.filter & 1 and f[3]) for f in mine)
    assert got.count() == 11 * 80


def test_parts_of_long_texts_end_between_words():
    r = random.Random(8)
    texts = ["", "x" * 30_000, " ".join(f"w{r.randrange(500)}" for _ in range(20_000)), "a b", " " * 9000 + "#", "é " * 9000]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    parts = list(word_parts(data, off, 1000))
    assert b"".join(p[2].tobytes() for p in parts) == b"".join(raw) and max(len(p[2]) for p in parts) < 31_000 and len(parts) > 100
    got = [filter_audit.failures(data, off)]
    for size in (1000, 7):
        filter_audit.CHUNK, old = size, filter_audit.CHUNK
        got.append(filter_audit.failures(data, off))
        filter_audit.CHUNK = old
    w = [WORD.findall(t) for t in texts]
    want = [(len(x) < 200) + 2 * (100 * len(set(x)) < 50 * len(x)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t)) for x, t in zip(w, texts)]
    assert all(g.tolist() == want for g in got)


def brute_shards(given, shards):
    order = sorted(((hashlib.md5((t or "").encode()).hexdigest(), d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in given))
    size = [x[3] for x in order]
    start = np.concatenate([[0], np.cumsum(size)]).tolist()
    total = start[-1]
    plain = [min(shards - 1, (2 * a + s) * shards // (2 * total)) for a, s in zip(start, size)]
    cuts = []
    for k in range(1, shards):
        at = next((i for i, p in enumerate(plain) if p >= k), None)
        if at is None:
            continue
        group = [i for i, x in enumerate(order) if x[0] == order[at][0]]
        lo, hi = start[group[0]], start[group[-1] + 1]
        if lo < start[at] and (hi - lo) * shards * 100 <= total:
            at = group[0] if 2 * total * k <= (lo + hi) * shards else group[-1] + 1
        cuts.append(at)
    out = Counter()
    for i, (_, some, d, s, crc) in enumerate(order):
        below = [c for c in cuts if c <= i]
        out[d if some else None, s, crc, "bytes", len(below), i - max(below, default=0), None] += 1
    return out


@pytest.mark.parametrize(("shards", "part_rows"), [(40, 50_000), (7, 9), (3, 25)])
def test_sharding(docs, given, shards, part_rows):
    got = sharding.assign(docs, shards=shards, part_rows=part_rows)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()) == brute_shards(given, shards)
    assert got.columns == ["doc_id", "source", "part", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.assign(docs.limit(0)).count() == 0


def test_copies_at_a_cut_stay_together(spark):
    """Small documents, each three or four times: no group is cut, and shards differ by a group at most."""
    given = [(i, f"text {i % 13_000} " + "x" * (i % 13_000 % 60), "a", "", "", "") for i in range(40_000)]
    got = [tuple(r) for r in sharding.assign(spark.createDataFrame(given, DOCS), part_rows=4000).select("doc_id", "size", "shard", "slot").collect()]
    of, total, slots = defaultdict(set), Counter(), defaultdict(list)
    for d, size, shard, slot in got:
        of[d % 13_000].add(shard)
        total[shard] += size
        slots[shard].append(slot)
    assert all(len(x) == 1 for x in of.values()) and sorted(total) == list(range(40))
    assert max(total.values()) - min(total.values()) < 8 * 90
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_one_text_in_nine_rows_of_ten_is_dealt_over_parts(spark):
    given = [(i, "the same text" if i % 10 else f"other {i}", "a", "", "", "") for i in range(6000)]
    docs = spark.createDataFrame(given, DOCS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in sharding.assign(docs, part_rows=500).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(got) == brute_shards(given, 40)


def test_shards_are_written_in_order(spark, docs, given, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(given) and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((d, t) for d, t, *_ in given)


# ---- conversation repair

LEGAL_ROLES = re.compile(r"(s?(ua)+)?\Z")


def brute_repair(rows):
    """The cheapest legal edits of (role, text, fault) by trying all of them: cost, audit, repaired text."""
    best = (10**9, "", "")
    n = len(rows)

    def go(i, cost, audit, out):
        nonlocal best
        if cost > min(best[0], 2 * n):
            return
        if i == n:
            for tail in ([], ["user"], ["assistant"], ["user", "assistant"]):
                roles = [r[:1] for r, _ in out] + [r[0] for r in tail]
                if LEGAL_ROLES.match("".join(x if x in "sua" and x else "?" for x in roles)):
                    got = (cost + 5 * len(tail), audit + "I" * len(tail), "\n".join([f"{r}:{t}" for r, t in out] + [f"{r}:" for r in tail]))
                    best = min(best, got)
            return
        role, text, fault = rows[i]
        for extra in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            now, c = out + [(r, "") for r in extra], cost + 5 * len(extra)
            mark = audit + "I" * len(extra)
            go(i + 1, c + 2, mark + "D", now)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, c + more, mark + "K", now + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, c + more + 1, mark + "R", now + [(r, text)])

    go(0, 0, "", [])
    return best


def brute_conversation(rows):
    """The result of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, tagged, count = set(), [], Counter()
    for _, role, text in rows:
        w = WORD.findall(text)
        fault = "blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        tagged.append((role, text, fault))
    initials = [r[1][:1] for r in rows]
    illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(initials, initials[1:]))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, text = brute_repair(tagged)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        got = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            got += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def talk(seed, conversations, longest):
    r = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "spy"])
            out.append((c if c else None, r.choice([t, t, t + 3, None]) if c % 3 else t, role, r.choice(["yes.", "no!", "why?", "cut off", "", None, " \t", "two\nlines.", "é. \n", "ok."]) if c % 2 else f"{role} says {t}."))
    return out


@pytest.mark.parametrize("size", [{}, {"chunk_rows": 1, "parts": 3}, {"chunk_rows": 2, "parts": 1}, {"chunk_rows": 3, "parts": 40}])
def test_conversation_repair(spark, size):
    given = talk(4, 160, 4) + talk(9, 12, 5)[:20]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damaged(df), **size).collect()}
    rows = damage(given)
    few = {c for c, x in rows.items() if len(x) <= 5}
    assert set(got) == set(rows) and len(few) > 140
    for conv in few:
        assert got[conv] == brute_conversation(rows[conv]), (conv, rows[conv])
    assert conversation_repair.repair(conversation_repair.damaged(df.limit(0)), **size).count() == 0


def test_a_conversation_of_nine_rows_in_ten_is_repaired_in_pieces(spark):
    r = random.Random(6)
    hot = [(7, i, r.choice(["user", "assistant", "system", "x"]), r.choice(["Hm.", f"number {i}.", f"cut {i}"])) for i in range(4000)]
    given = hot + [(c, i, ["user", "assistant"][i % 2], f"{c} {i}.") for c in range(8, 108) for i in range(4)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = conversation_repair.damaged(df)
        found = conversation_repair.pieces(conversation_repair.marked(rows), chunk_rows=100, parts=9).select("conv", "part", "open", "faults").collect()
        parts = [tuple(sorted((tuple(r) for r in conversation_repair.repair(rows, **size).collect()))) for size in ({"chunk_rows": 100, "parts": 9}, {"chunk_rows": 10**6, "parts": 1})]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pieces = [x for x in found if x.conv == 7]
    assert len(pieces) >= 40 and max(len(x.faults) for x in pieces) <= 101 and len({x.part for x in pieces}) >= 7
    assert parts[0] == parts[1] and len(parts[0]) == 101
    mine = next(x for x in parts[0] if x[0] == 7)
    faults = sorted(damage(given)[7], key=lambda x: x[0])
    costs, order, steps = conversation_repair.forward([(x[1][:1], f) for x, f in zip(faults, [f for p in sorted(pieces, key=lambda p: p.part) for f in p.faults])], 0)
    end = conversation_repair.last_state(costs, order)
    assert mine[6] == costs[end] + 5 * len(conversation_repair.AFTER[end])


def test_a_very_long_turn(spark):
    long = "word " * 3_000_000 + "end."
    df = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", long[:-1] + "?"), (2, 1, "user", "hi.")], "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in conversation_repair.repair(conversation_repair.damaged(df)).collect()}
    rows = damage([(1, 1, "user", long), (1, 2, "assistant", long[:-1] + "?"), (2, 1, "user", "hi.")])
    for c in (1, 2):
        assert tuple(got[c])[1:] == brute_conversation(rows[c])
