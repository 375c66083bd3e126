"""Merkle manifest, conversation trie and repeated passages on small tables, against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import merkle, repeats, trie
from tidewake.llm.common import bloom_of

# --- Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """(top, siblings of each node on all levels, left and right apart)."""
    paths = [[] for _ in nodes]
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            first = at - at % 16
            paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
            own[k] = at // 16
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for group, key, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = plain_tree([own[g][0] for g in order])
    out = []
    for g, top in zip(order, above, strict=True):
        out += [(g, k if some else None, leaf, own[g][0], root, path + top) for (some, k, leaf), path in zip(sorted(groups[g]), own[g][1], strict=True)]
    return out


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_manifest_against_a_plain_one(spark, block):
    rng = random.Random(block)
    sizes = {None: 1, "": 2, "é": 300, "a": 16, "b": 17, "\U00010000": 40, "￿": 1} | {f"s{k}": 1 for k in range(30)}
    rows = [(g, rng.choice([None, *range(500)]), h(str(rng.random()))) for g, n in sizes.items() for _ in range(n)]
    rows += [("b", 3, rows[0][2])] * 4  # equal rows
    df = spark.createDataFrame([(g, k, leaf, "mine", 5) for g, k, leaf in rows], "source string, doc_id long, leaf string, root string, pos int")
    got = merkle.manifest(df.withColumnRenamed("root", "block"), "source", "doc_id", leaves_per_block=block)
    checked = got.withColumn("ok", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert all(r["ok"] and r["block"] == "mine" and r["pos"] == 5 for r in checked)
    mine = [(r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]]) for r in checked]
    assert sorted(map(str, mine)) == sorted(map(str, plain_manifest(rows)))


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([("a", 1, h("x"))], "source string, doc_id long, leaf string")
    r = merkle.manifest(df, "source", "doc_id").first()
    assert (r["subroot"], r["root"], r["proof"]) == (h("x"), h("x"), [])
    assert merkle.manifest(df.where("false"), "source", "doc_id").count() == 0


def test_manifest_query_with_nulls_in_every_column(spark, tmp_path):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else "TeXt é" * (i % 4), None if i % 11 == 0 else "en", None if i % 6 == 0 else f"src{i % 3}", None if i % 13 == 0 else i) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    want = []
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by_leaf = {leaf(r, r[1]): leaf(r, lower(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]) for r in rows}
    for _, key, own, subroot, root, path in plain_manifest([(r[3], r[0], leaf(r, r[1])) for r in rows]):
        folded = by_leaf[own]
        for a, b in path:
            folded = h(a + folded + b)
        want.append((key, own, subroot, root, h("".join(a + b for a, b in path)), folded, folded == root))
    got = [tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[-1] for r in got} == {True, False}


# --- conversation trie


def plain_rebuilt(rows):
    """Rebuilt turns of each conversation, from (conv_id, turn, role, text)."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        borrowed = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = turns.get(base, [])[:borrowed] + own[borrowed:]
    return out


def plain_trie(rebuilt):
    members = collections.defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids, below = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, convs in members.items():
        saved = (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            below[key[:d]][0] += key not in kids
            below[key[:d]][1] += saved
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(key))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), kids[key], *below[key], h(ends)))
    return out


CONV = "conv_id long, turn long, role string, text string, depth string, n int"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("segment", "most", "chunk"), [(64, 100_000, 4096), (3, 20, 2)])
def test_trie_against_a_plain_one(spark, tmp_path, monkeypatch, segment, most, chunk):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rng = random.Random(segment)
    texts = ["", "é", "hello", "hello there", "ok"]
    rows = []
    for c in [*range(-7, 60), 1000, 1001, 1004, 2003, 3001, 911, 912, 913, 914]:
        for t in range(1 if 910 < c < 915 else rng.choice([1, 2, 5, 9, 14, 30])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(texts)))
    rows += [(70 + 5 * k, t, "user", "same") for k in range(40) for t in range(20)]  # one hot conversation
    rows += [(401, t, "user", f"turn {t}") for t in range(300)] + [(405, None, None, None), (407, 3, "a", "late"), (407, None, "b", "first"), (None, 1, "user", "nobody")]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], CONV)
    rebuilt = plain_rebuilt(rows)
    assert [] in rebuilt.values()  # a conversation without turns
    turns = trie.rebuilt_turns(trie.numbered_turns(df.repartition(5)))
    got = [tuple(r) for r in trie.prefix_trie(turns).select(*TRIE).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(rebuilt)))


def test_radix_tree_changes_layouts_and_splits_paths():
    rng = random.Random(4)
    ids = [bytes([k]) + rng.randbytes(15) for k in range(256)] + [b"\x07" * 8 + rng.randbytes(8) for _ in range(30)]
    keys = [[rng.choice(ids[:n]) for _ in range(rng.randint(0, 4))] for n in (3, 12, 40, 286) for _ in range(300)]
    for part in (keys[:300], keys[:600], keys[:900], keys):
        forest = trie.Forest()
        kinds = set()
        for conv, key in enumerate(part):
            lanes = [int.from_bytes(x[8:]) >> 1 for x in key]
            forest.add(conv, 0, 0, 0, key, lanes, [2 * (d + 1) for d in range(len(key))], [1] * len(key), 1 << 62, 0, 0)
        root = forest.roots[0, 0, 0]
        todo = [root]
        while todo:
            node = todo.pop()
            kinds.add((type(node.branches).__name__, getattr(node.branches, "room", 0)))
            todo += node.branches.kids
        counts = collections.Counter()
        least = {}
        for conv, key in enumerate(part):
            for d in range(len(key) + 1):
                counts[tuple(key[:d])] += 1
                least.setdefault(tuple(key[:d]), conv)
        rows = list(forest.rows())
        assert sorted((r[5], r[6], r[2]) for r in rows) == sorted((counts[k], least[k], len(k)) for k in counts)
        assert sum(r[2] == 0 for r in rows) == 1
    assert {("Small", 4), ("Full", 0)} <= kinds
    few = trie.Node(b"", 0, 0)
    for k, key in enumerate(ids[:40]):
        trie.insert(few, key, k, k, 0, 0, 0)
        assert [x for x in few.branches.kids if x.path == key]
    assert isinstance(few.branches, trie.Indexed)


def test_trie_of_no_conversations(spark):
    empty = spark.createDataFrame([], CONV)
    assert trie.prefix_trie(trie.rebuilt_turns(trie.numbered_turns(empty))).count() == 0


# --- repeated passages


def plain_repeats(rows, width):
    """(kept text, words, removed) of each row, from all windows of all rows."""
    first, texts = {}, []
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.append(found)
        for k in range(len(found) - width + 1):
            window, rank = tuple(found[k : k + width]), (i is not None, i or 0)
            first[window] = min(first.get(window, rank), rank)
    out = []
    for (i, _), found in zip(rows, texts, strict=True):
        gone, seen = set(), set()
        for k in range(len(found) - width + 1):
            window = tuple(found[k : k + width])
            if first[window] < (i is not None, i or 0) or window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        out.append((" ".join(w for k, w in enumerate(found) if k not in gone), len(found), len(gone)))
    return out


def repeat_rows(rng, words, n):
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [prose(rng.randint(4, 70)) for _ in range(6)]
    rows = [(i, " \n".join(itertools.chain.from_iterable(rng.choice([prose(rng.randint(0, 15)), rng.choice(passages)]) for _ in range(rng.randint(0, 9))))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(15)] + [(2, rows[5][1]), (2, rows[2][1]), (None, rows[4][1]), (None, None), (n + 50, ""), (n + 51, None)]
    period = ["a", "b", "b", "a", "c"]
    rows += [(n + 60, " ".join(["x"] * 90)), (n + 61, " ".join(period * 30)), (n + 62, "\x0b\x1c ".join(period * 20)), (n + 63, "É\u00a0é 漢字\u2003🙂 " * 30)]
    rows += [(n + 64, " ".join(prose(3000) + passages[0] + prose(2000) + passages[1]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "stretch", "alphabet"), [(20, 1 << 17, 300), (20, 50, 3), (7, 1 << 17, 2), (3, 10, 40)])
def test_repeats_against_all_windows(spark, width, stretch, alphabet):
    rng = random.Random(width + stretch)
    rows = repeat_rows(rng, [f"W{k}" for k in range(alphabet)], 60)
    df = spark.createDataFrame([(k, i, t, "mine") for k, (i, t) in enumerate(rows)], "k int, doc_id long, text string, gone string").repartition(6)
    got = repeats.without_repeats(df, width=width, stretch=stretch).orderBy("k").collect()
    assert all(r["gone"] == "mine" for r in got)
    want = plain_repeats(rows, width)
    assert [(r["kept_text"], r["kept_words"], r["removed_words"]) for r in got] == want
    assert sum(x[2] for x in want) > 0


def test_symbols_of_equal_words_are_equal():
    """Wherever a passage stands, the symbols whose spans lie in it are the same."""
    import numpy as np

    rng = np.random.default_rng(6)
    for alphabet in (2, 5, 1000):
        names = rng.integers(0, 1 << 63, alphabet).astype(np.uint64)
        passage = names[rng.integers(0, alphabet, 40)]
        found = []
        for before, after in ((0, 0), (3, 50), (60, 1), (17, 17)):
            words = np.concatenate([names[rng.integers(0, alphabet, before)], passage, names[rng.integers(0, alphabet, after)]])
            at = repeats.Symbols(words, np.zeros(len(words), np.int64), np.array([0]), np.array([len(words)]))
            levels = []
            for turn in range(3):
                at = at.runs().pairs(turn)
                assert (np.diff(at.lo) >= 0).all() and (np.diff(at.hi) >= 0).all()
                inside = (at.lo >= before) & (at.hi <= before + 40)
                levels.append(list(zip(at.names[inside].tolist(), (at.lo[inside] - before).tolist(), (at.hi[inside] - before).tolist(), strict=True)))
            found.append(levels)
        assert all(x == found[0] for x in found) and found[0][0]


def test_repeats_of_no_documents(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    few = spark.createDataFrame([("b", "one two three one two"), ("a", "one two"), (None, "two three")], "doc_id string, text string")
    assert {(r["doc_id"], r["kept_text"]) for r in repeats.without_repeats(few, width=2).collect()} == {("b", ""), ("a", "one two"), (None, "two three")}


def test_repeats_hold_few_texts_and_one_python_worker_a_task(spark, monkeypatch):
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), repeats.materialise

    def noted(df, label):
        held.append((label, int(spark.conf.get(name))))
        return write(df, label)

    monkeypatch.setattr(repeats, "materialise", noted)
    docs = spark.createDataFrame([(k, f"a b c {k % 7} {k}") for k in range(5000)], "doc_id long, text string")
    out = repeats.without_repeats(docs, width=2)
    sizes = dict(held)
    assert sizes["repeat-keys"] <= repeats.ROWS and sizes["repeat-groups"] <= repeats.ROWS and spark.conf.get(name) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert out.agg(F.sum("removed_words")).first()[0] == 3 * 4999 + 4993


def test_the_filter_of_hashes_in_columns(spark):
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    held = bloom_of(rows.where("id < 300").select(F.col("h").alias("hash")))
    found = rows.join(F.broadcast(held.row(spark)), held.holds_column("h"), "left_semi").toPandas()
    all_ = rows.toPandas()
    want = all_[held.holds(all_["h"].to_numpy().view(np.uint64))]
    assert sorted(found["id"]) == sorted(want["id"]) and len(want) >= 300
