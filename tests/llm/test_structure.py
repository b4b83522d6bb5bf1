"""Conversation repair, sharding and the filter audit against brute force and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from conftest import SF
from talkweave.llm import conversations, filter_audit, sharding

# 11


def brute_aligned(codes):
    """Every target by itself, every edit; the least (cost, audit) of all."""
    best = None
    for m in range(len(codes) + 6):
        if m == 1:
            continue
        target = "s" * (m % 2) + "ua" * (m // 2)

        @lru_cache(None)
        def go(i, j, target=target):
            if i == len(codes) and j == len(target):
                return 0, ""
            ways = []
            if i < len(codes):
                ways.append((3, "D", go(i + 1, j)))
                if j < len(target) and codes[i] != "-":
                    late = int(codes[i].isupper())
                    if codes[i].lower() == target[j]:
                        ways.append((late, "K", go(i + 1, j + 1)))
                    if target[j] != "s":
                        ways.append((late + 2, "R", go(i + 1, j + 1)))
            if j < len(target) and target[j] != "s":
                ways.append((2, "I", go(i, j + 1)))
            return min(((c + rest, e + audit) for c, e, (rest, audit) in ways), default=(10**9, ""))

        best = min(filter(None, [best, go(0, 0)]))
    return best


def test_alignment_is_the_cheapest():
    rng = random.Random(5)
    short = ["".join(c) for n in range(4) for c in itertools.product("suaoSA-", repeat=n)]
    longer = ["".join(rng.choice("uauauasUAoS-") for _ in range(rng.randint(4, 13))) for _ in range(400)]
    for codes in short + longer:
        assert conversations.aligned(codes) == brute_aligned(codes), codes


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(conversations, "MEMO", 100)
    memo = conversations.Aligned()
    for codes in ("u", "ua", "uau", "s", "ua", "-"):
        assert memo[codes] == conversations.aligned(codes) and len(memo) <= 3


def brute_repair(rows):
    """op11's contract, row by row in Python."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        own = talks[conv]
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            left = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        codes = "".join("-" if f in ("blank", "duplicate") else (c := r[:1] if r[:1] in ("s", "u", "a") else "o", c.upper())[f == "truncated"] for f, (_, r, _) in zip(faults, own, strict=True))
        cost, audit = brute_aligned(codes)
        lines, i, user = [], 0, True
        for e in audit:
            role, text = (None, "") if e == "I" else own[i][1:]
            i += e != "I"
            if e != "D":
                role = role if e == "K" else "user" if user else "assistant"
                lines.append(f"{role}:{text}")
                user = role[0] != "u"
        count = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    """Invented turns: nulls in each column, odd roles, repeated rows, ties, blanks, gaps, a long conversation."""
    rng = random.Random(11)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Ja.", "No!", "Why?", "cut", "", " \t", "late. \n", "é．", None, "Ja."])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, None, None, None), (70, 5, "user", "Twice."), (70, 5, "user", "Twice."), (70, 5, "assistant", "Tie."), (71, 2**40, "user", "Far."), (71, -3, "assistant", "Near.")]
    rows += [(80, t, "ua"[t % 2] + "x", f"Line {t}.") for t in range(120)]
    return rows


def test_repair_equals_brute_force(spark, talks):
    df = spark.createDataFrame([(*r, "fp", 1) for r in talks], "conv_id long, turn long, role string, text string, sha string, pos int")
    got = conversations.repaired(conversations.damaged(df)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repair(talks)


def test_dropped_conversations_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Only turn.")], "conv_id long, turn long, role string, text string")
    row = conversations.repaired(conversations.damaged(df)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.repaired(conversations.damaged(df.limit(0))).count() == 0


# 12


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None), (None, "", "en"), (None, "", "en"), (3, "ü 東京", "de"), (4, "x" * 200_000, None)] + [(7, "same", "fr")] * 9000 + [(i, f"text {i % 50}", "en") for i in range(100, 2100)]
    return spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, lang string, shard int, range string")


def test_shards_of_odd_rows(odd):
    tree = sharding.tree_of(8)
    got = sharding.assigned(odd, tree, sharding.grown(tree)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(8):
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in own]
        assert keys == sorted(keys)
    at = {r.doc_id: (r.shard, r.grown_shard) for r in got}
    assert all((r.shard, r.grown_shard) == at[r.doc_id] for r in got)
    assert sharding.assigned(odd.limit(0), tree).count() == 0


def test_rows_move_only_where_weights_change(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    trees = [sharding.tree_of(n) for n in range(8, 12)]
    rows = ids.select(*[sharding.placed(F.col("doc_id"), t)["shard"].alias(f"n{len(sharding.children(t)['']) + 6}") for t in trees]).collect()
    for k, (small, large) in enumerate(itertools.pairwise(range(8, 12))):
        moved = [r for r in rows if r[k] != r[k + 1]]
        assert {r[k + 1] for r in moved} == {large - 1}
        assert abs(len(moved) / 20_000 - 1 / large) < 0.01
    for k, n in enumerate(range(8, 12)):
        sizes = Counter(r[k] for r in rows)
        assert len(sizes) == n and max(abs(s - 20_000 / n) for s in sizes.values()) < 5 * (20_000 / n) ** 0.5
    # A heavier shard in an old rack: rows leave every other subtree only for the region, and in it only for the rack, that grew.
    tree, heavy = trees[0], {"0": {"0": {0: 3.0, 1: 1.0}, "1": {2: 1.0, 3: 1.0}}, "1": trees[0]["1"]}
    both = ids.select(sharding.placed(F.col("doc_id"), tree).alias("a"), sharding.placed(F.col("doc_id"), heavy).alias("b")).where("a <> b").collect()
    assert both and all(r.b.region == "0" for r in both)
    assert all(r.b.shard == 0 for r in both if r.a.rack == "0" and r.a.region == "0")
    assert all(r.b.rack == "0" for r in both if r.a.region == "0")
    share = ids.where(sharding.placed(F.col("doc_id"), heavy)["shard"] == 0).count() / 20_000
    assert abs(share - 0.3) < 0.02
    assert set(r.to_shard for r in sharding.moves(ids, tree, sharding.grown(tree)).collect()) == {8}


def test_written_shards(spark, odd, tmp_path):
    few = odd.where("doc_id between 100 and 300").drop("shard", "range").withColumn("digest", F.md5("text"))
    sharding.write_shards(few, str(tmp_path / "shards"), sharding.tree_of(8), key="digest")
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 201
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_weightless_shards_get_nothing(spark):
    tree = {"0": {"0": {0: 0.0, 1: 1.0}}, "1": {"0": {2: 0.0}}}
    assert {r[0] for r in spark.range(50).select(sharding.placed(F.col("id"), tree)["shard"]).collect()} == {1}
    with pytest.raises(ValueError):
        sharding.children({"0": {"0": {0: 0.0}}})


# 13


def brute_audit(docs, labels):
    """Every order walked over every document."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        words = text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        parts[lang or ""].append((fails + "E" * (d is not None and first[text] < d), d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        sums, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                sums[f] += len(gone)
                lines.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*x[:9], sums[x[9]]) for x in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    pool = ["", None, "short", "Only Some Words HERE", "a b # c", " ".join(f"w{i}" for i in range(250)), "again " * 260, "X | " * 300, "é" * 5000, "LOUD " + "x " * 220, " a b " * 210]
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(None, "short", "en"), (None, "short", "en"), (None, None, None), (5, "twice", "fr"), (5, "twice", "fr"), (4, "twice", "de"), (4, "twice", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, lang string, n int, digest string")
    l = spark.createDataFrame([(*x, 2) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.audited(filter_audit.failure_counts(d, l)).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(docs, labels)
    assert filter_audit.audited(filter_audit.failure_counts(d.limit(0), l.limit(0))).count() == 0


def test_paths_of_the_lattice(spark):
    edges = filter_audit.lattice()
    assert len(edges) == 80 and sum(e[3] for e in edges) == 5 * 120
    walked = Counter((r.state, r["filter"]) for r in filter_audit.steps(spark).collect())
    assert walked == {(state, f): orders for state, f, _, orders in edges}


def test_whole_table(spark):
    from talkweave.llm.queries import QUERIES

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_filter_audit"](spark, SF).collect()) == brute_audit(rows, labels)
    talks = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_conversations"](spark, SF).collect()), key=repr) == brute_repair(talks)
