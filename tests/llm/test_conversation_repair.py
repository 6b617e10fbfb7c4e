import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from wareloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def after_damage(conv, turns):
    out = []
    for t, r, x in turns:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        x = "" if hit == 1 else "".join(c for c in x if c not in ".!?") if hit == 2 else x
        out += [(t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda s: (s[0] is not None, s[0] or 0, s[1], s[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, r, x in rows:
        s = x.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, faults):
    """Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(lines)
        name, to = NEXT[q]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, lines + (name + ":",)))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, to, lines + (f"{name}:{x}",)))
                if (q, r[:1]) in KEEP:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, KEEP[q, r[:1]], lines + (f"{r}:{x}",)))


def brute_force(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = after_damage(conv, [r[1:4] for r in rows if r[0] == conv])
        faults = faults_of(kept)
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, text = cheapest(kept, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a.", "b", "Hello there!", "x y\n", " z? "]
    return [(rng.choice([None, 7, 7, 7, rng.randint(10, 60)]), rng.choice([None, *[rng.randint(0, n)] * 3]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
             rng.choice([*texts, f"q{rng.randint(0, n)}.", f"w{rng.randint(0, n)}"])) for _ in range(n)]


@pytest.mark.parametrize("least_block", [1, 8])
def test_equals_brute_force(spark, least_block):
    """One conversation holds most rows and spans many blocks; turns and whole rows repeat."""
    rows = random_rows(900, least_block)
    rows += rows[:40]
    got = repair.audited(spark.createDataFrame(rows, SCHEMA).repartition(5), least_block).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == brute_force(rows)
    assert len(got) == len({r[0] for r in rows})


def test_all_short_sequences():
    """The walk over every short sequence of roles and faults, cut into blocks at every place, against all edit sequences."""
    symbols = [role + 4 * fault for role in range(4) for fault in range(3)]
    for rows in itertools.chain.from_iterable(itertools.product(symbols, repeat=n) for n in range(1, 4)):
        want = cheapest([(0, "suat"[s & 3], "") for s in rows], [("", "truncated", "blank")[s >> 2] for s in rows])[:2]
        for cut in range(1, len(rows) + 1):
            parts = [p for p in (rows[:cut], rows[cut:]) if p]
            vectors = [repair.END]
            for part in reversed(parts):
                vectors.insert(0, tuple(repair.before(repair.transfer(part), vectors[0])))
            q, audit = 0, ""
            for k, part in enumerate(parts):
                letters, q = repair.walk(part, vectors[k + 1], q, k == len(parts) - 1)
                audit += letters
            assert (vectors[0][0], audit) == want, rows


def test_repaired_rows_alternate(spark):
    lines = repair.Repair(spark.createDataFrame(random_rows(300, 3), SCHEMA), 2).repaired().orderBy("key", "at", "place").collect()
    for _, group in itertools.groupby(lines, key=lambda r: r.key):
        initials = "".join(r.role[:1] for r in group)
        body = initials.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)


def test_odd_tables(spark):
    schema = SCHEMA + ", `key` string, at long, `a.b` int"
    assert repair.audited(spark.createDataFrame([], schema)).collect() == []
    hit = {n: next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == n) for n in (0, 3, 9)}
    rows = [(hit[0], 0, "user", "gone.", "k", 1, 1), (hit[3], 0, None, None, "k", 1, 1), (hit[9], 0, "user", "word " * 50000 + ".", None, None, None)]
    got = {r.conv_id: r for r in repair.audited(spark.createDataFrame(rows, schema)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[hit[0]][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got[hit[3]][c] for c in COLUMNS) == (0, 2, 0, 0, 1, 6, "DD", empty)
    assert got[hit[9]].audit == "KI"
