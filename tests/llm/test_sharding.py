import random
import zlib

from tessella.llm.sharding import shard, splitters


def check(spark, rows, shards=8, extra=""):
    out = shard(spark.createDataFrame(rows, "doc_id long, text string" + extra), shards).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    slots = {}
    for r in out:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return out


def totals(out, shards):
    bytes_ = [0] * shards
    for r in out:
        bytes_[r.shard] += r["size"]
    return bytes_


def test_sizes_are_near_equal_and_groups_whole(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300) + str(i // 2)) for i in range(4000)]
    out = check(spark, rows)
    sizes = totals(out, 8)
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) <= 0.02 * mean + 700
    homes = {}
    for r in out:
        homes.setdefault(r.text, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_a_group_of_copies_is_split(spark):
    rows = [(i, "copy" * 50) for i in range(2000)] + [(5000 + i, f"own {i}") for i in range(2000)]
    sizes = totals(check(spark, rows), 8)
    assert max(sizes) - min(sizes) <= 3 * 216


def test_splitters_equal_a_sorted_scan(spark):
    rng = random.Random(2)
    keys = [(rng.randint(-5, 5) * 10**17, rng.randint(0, 10**6), rng.randint(16, 400)) for _ in range(500)]
    found = splitters(spark.createDataFrame(keys, "h long, d long, size long"), 5, 0.0)
    total = sum(k[2] for k in keys)
    ordered = sorted(keys)
    for n, bound in enumerate(found, 1):
        below = sum(k[2] for k in ordered if (k[0], k[1]) < bound)
        target = total * n // 5
        best, run = target, 0
        for k in ordered:
            run += k[2]
            best = min(best, abs(target - run))
        assert abs(below - target) == best


def test_defined_cases(spark):
    check(spark, [(1, None, 3), (2, "", 3), (None, "a", 3), (3, "b" * 200_000, 3), (4, "c", 3), (4, "c", 3)], extra=", slot int")
    check(spark, [])
    assert [r.shard for r in check(spark, [(7, "only")])] in ([[i] for i in range(8)])
