"""The trie against brute force: odd tables, hot prefixes, runs of any size; the tree's layouts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import prefix_trie


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        spared = (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += spared
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out[min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    return Counter(map(tuple, prefix_trie.conversation_trie(turns.repartition(3), **options).collect()))


def odd_rows():
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d e f"])) for c in range(160) for k in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (300, None, "u", "null first"), (300, 0, "u", "then"), (300, 0, "u", "then"), (301, 1, "ab", "c"), (302, 1, "a", "bc")]
    rows += [(400, k, "u", f"turn {k}") for k in range(300)] + [(401, 0, "u", "é " * 100_000)]
    return rows


@pytest.mark.parametrize("run_keys", [1, 9, 4096])
def test_odd_tables(spark, run_keys):
    rows = odd_rows()
    assert trie(spark, rows, run_keys=run_keys) == brute(rebuild(rows))


def test_small_runs_by_bytes(spark):
    rows = odd_rows()
    assert trie(spark, rows, run_bytes=400) == brute(rebuild(rows))


def test_hot_key_over_many_runs(spark):
    """A third of the conversations are the same one, another third share a long beginning."""
    rows = [(c * 20, 0, "u", "same words here") for c in range(300)]
    rows += [(c * 20, k, "u", f"shared {k}" if k < 12 else f"own {c} {k}") for c in range(300, 600) for k in range(14)]
    rows += [(c * 20, 0, "u", f"alone {c}") for c in range(600, 900)]
    assert trie(spark, rows, run_keys=16) == brute(rebuild(rows))


def test_turnless_and_empty(spark):
    absent = next(c for c in range(20, 40) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(absent, 0, "u", "goes, for the block's first conversation is absent")]
    root = trie(spark, rows)
    assert root == brute(rebuild(rows)) == Counter([(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())])
    assert not trie(spark, []) and not trie(spark, [(None, None, None, None)])
    assert trie(spark, [(5, None, None, None)]) == brute(rebuild([(5, None, None, None)]))


def test_run_is_the_same_in_one_piece_or_many():
    """Levels without Spark: runs of any cut give the whole run's nodes."""
    rng = random.Random(1)
    keys = sorted({b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(6))) for _ in range(200)})
    words = [[1] * (len(k) // 16) for k in keys]
    adds = [[(len(k) // 16, (1, i, 0, 0, 0))] for i, k in enumerate(keys)]
    want = Counter((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in prefix_trie.run_rows(keys, words, adds, list(range(len(keys))), True))
    for cut in (1, 7, len(keys) // 2, len(keys) - 1):
        got, entries = Counter(), []
        for part in (slice(0, cut), slice(cut, None)):
            for r in prefix_trie.run_rows(keys[part], words[part], adds[part], list(range(len(keys)))[part], False):
                if r["kind"] == prefix_trie.NODE:
                    got[r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]] += 1
                elif r["kind"] == prefix_trie.ENTRY:
                    entries.append(r)
        more = [[(d, tuple(e["sums"][5 * k : 5 * k + 5])) for k, d in enumerate(e["depths"])] for e in entries]
        for r in prefix_trie.run_rows([e["key"] for e in entries], [e["words"] for e in entries], more, None, True):
            got[r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]] += 1
        assert got == want


@pytest.mark.parametrize("n", [3, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow(n):
    tree = prefix_trie.RadixTree()
    given = random.Random(n).sample(range(256), n)
    made = {b: tree.node(b"shared" + bytes([b]) + b"tail", 0) for b in given}
    top = tree.root.below.find(ord("s"))
    kind = type(top.below).__name__
    assert kind == ("Sorted" if n <= 16 else "Indexed" if n <= 48 else "Full") and top.path == b"hared" and len(top.below.kids) == n
    assert all(tree.node(b"shared" + bytes([b]) + b"tail", 1) is x for b, x in made.items())
    inner = tree.node(b"sha", 2)
    assert inner.path == b"ha" and len(inner.below.kids) == 1 and all(tree.node(b"shared" + bytes([b]) + b"tail", 1) is x for b, x in made.items())
