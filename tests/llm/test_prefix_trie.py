import hashlib
import random
import zlib
from collections import defaultdict

from depthline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d long, name string, n long"


def brute_trie(rows):
    """Nodes by whole prefixes as keys."""
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            conversations[conv].append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    turns = {k: [(t[1], t[3]) for t in sorted(v)] for k, v in conversations.items()}
    members = defaultdict(list)
    size = {}
    for k, v in turns.items():
        h = zlib.crc32(str(k).encode()) % 9
        base = k - (abs(k) % 5) * (1 if k >= 0 else -1)
        whole = turns.get(base, [])[:h] + v[h:]
        size[k] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(k)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        below, m = kids.get(node, []), members[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(m) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = hashlib.sha256(",".join(map(str, sorted(k for k in m if size[k] == len(node)))).encode()).hexdigest()
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(below), leaves[node], saved[node], ends))
    return out


def test_trie_matches_whole_prefixes_with_nulls_ties_repeats_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, t, None, 1]), rng.choice(["u", "a", None]), rng.choice(["x", "ü", "", None, "long " * 5]), 1, "q", 3) for c in range(-3, 40) for t in range(rng.randint(0, 12))]
    rows += [(100, t % 7, "u", "a", 1, "", 1) for t in range(40)] + [(105, t, "u", "b" * (t % 3), 1, "", 1) for t in range(70)]
    rows += [(107, 5, "u", "same", 1, "", 1)] * 40 + [(None, 1, "u", "x", 1, "", 1)]
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    want = brute_trie([r[:4] for r in rows])
    assert len(got) == len(want) and set(got) == want


def test_trie_of_one_opening_shared_by_most_and_of_nothing(spark):
    rows = [(5 * c, t, "user" if t % 2 else "system", "the same" if t < 3 else f"own {c % 40}", 1, "", 1) for c in range(300) for t in range(5)]
    assert {tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_trie([r[:4] for r in rows])
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
