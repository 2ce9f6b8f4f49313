"""The conversation trie against lists of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import conversation_trie

ROWS = "conv_id long, turn long, role string, text string, node string, depth int, task long, first long"


def splice():
    return {"base": F.col("conv_id") - F.col("conv_id") % 5, "head": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9}


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:31]


def brute(rows, spliced=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), role, text))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = (zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)) if spliced else (0, c)
        built[c] = (*own.get(base, [])[:h], *turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = own_saved + sum(saved[x] for x in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS)


@pytest.fixture
def many_parts(spark):
    """No joining of small partitions, so that pieces of a conversation lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_equals_lists(spark, many_parts):
    rng = random.Random(11)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        if c % 7 == 3:
            continue
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([None, turn, turn, 3]), rng.choice([None, "user", "", "ü"]), rng.choice([None, "", "a", "b", "né", "long " * 5000])))
    rows += [(None, 1, "user", "no id"), (4, 2, "user", "again"), (4, 2, "user", "again"), (65, 0, None, None)]
    assert got(conversation_trie.trie(frame(spark, rows), **splice())) == brute(rows)
    assert got(conversation_trie.trie(frame(spark, rows))) == brute(rows, spliced=False)
    assert conversation_trie.trie(frame(spark, []), **splice()).count() == 0


def test_long_conversation_over_several_tasks(spark, many_parts):
    """One conversation with most of the rows, of which others have a part; its pieces lie in more than one partition."""
    rows = [(5, t, "user", f"t{t % 40}") for t in range(300)] + [(c, t, "user", f"t{t % 40}") for c in (6, 7, 8, 20) for t in range(50)]
    turns = frame(spark, rows)
    placed = conversation_trie.ordered_turns(turns).where("conv_id = 5")
    assert placed.select("part").distinct().count() > 1
    assert got(conversation_trie.trie(turns, **splice())) == brute(rows)


def test_equal_conversations_and_small_tables(spark, many_parts, monkeypatch):
    """Copies over many pieces of end lists, partial tries let go of at once, and several rounds of merging."""
    monkeypatch.setattr(conversation_trie, "FAN", 2)
    rows = [(c * 997, t, "user", f"t{t}") for c in range(700) for t in range(3)]
    assert got(conversation_trie.trie(frame(spark, rows))) == brute(rows, spliced=False)
