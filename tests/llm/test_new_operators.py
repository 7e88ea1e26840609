"""Conversation repair, bottom-k fingerprints and token alignment, each against a plain version."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from finlake.llm import bottomk, conversation_repair, token_alignment
from finlake.llm.common import read

NEXT = (2, 2, 3, 2)


# conversation repair
def plain_repair(codes):
    """The least (cost, audit), by all ways on from each row and state."""
    best = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for x in reversed(codes):
        now = []
        for state in range(4):
            ways, at = [], state
            for added in range(4):
                moves = [(2, "D", at)]
                if not x & 4:
                    kind, more = x & 3, 5 if x & 8 else 0
                    legal = {1: (0,), 2: (0, 1, 3), 3: (2,)}.get(kind, ())
                    moves += [(more, "K", kind)] if at in legal else []
                    moves.append((1 + more, "R", NEXT[at]))
                ways += [(5 * added + c + best[to][0], "I" * added + letter + best[to][1]) for c, letter, to in moves]
                at = NEXT[at]
            now.append(min(ways))
        best = now
    return best[0]


def test_layers_give_the_least_audit():
    rng = random.Random(7)
    for _ in range(2000):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 2, 3, 4, 6, 7, 8, 9, 10, 11]) for _ in range(rng.randint(0, 9)))
        want = plain_repair(codes)
        assert {conversation_repair.solve(codes, block) for block in (1, 2, 3, 1024)} == {want}, list(codes)
    codes = bytes(rng.choice([2, 3, 2, 3, 4, 10, 11, 1]) for _ in range(700))
    assert conversation_repair.solve(codes, 64) == plain_repair(codes)


def plain_conversations(rows):
    """The query's rows by plain code."""
    text = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, body in rows:
        group = groups.setdefault(conv, [])
        role, body = text(role), text(body)
        at = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if at == 0:
            continue
        body = "" if at == 1 else body.translate({ord(c): None for c in ".!?"}) if at == 2 else body
        role = "user" if at == 4 else role
        group += [(turn is not None, turn or 0, role.encode(), body.encode())] * (2 if at == 3 else 1)
    out = {}
    for conv, group in groups.items():
        group.sort()
        seen, codes, counts, illegal = set(), [], dict.fromkeys("bdt", 0), 0
        for k, (_, _, role, body) in enumerate(group):
            code = {b"s": 1, b"u": 2, b"a": 3}.get(role[:1], 0)
            if not body.strip(b" \t\n\x0b\x0c\r"):
                counts["b"], code = counts["b"] + 1, code | 4
            elif (role, body) in seen:
                counts["d"], code = counts["d"] + 1, code | 4
            elif body.strip(b" \t\n\x0b\x0c\r")[-1:] not in (b".", b"!", b"?"):
                counts["t"], code = counts["t"] + 1, code | 8
            seen.add((role, body))
            illegal += k > 0 and group[k - 1][2][:1] + role[:1] not in (b"su", b"ua", b"au")
            codes.append(code)
        cost, audit = plain_repair(codes)
        turns = [g[1] for g in group if g[0]]
        lines, state, left = [], 0, iter(group)
        for letter in audit:
            role, body = ("", b"")
            if letter != "I":
                _, _, role, body = next(left)
            if letter == "D":
                continue
            state = {b"s": 1, b"u": 2, b"a": 3}[role[:1]] if letter == "K" else NEXT[state]
            name = role if letter == "K" else (b"user", b"assistant")[state - 2]
            lines.append(name + b":" + body)
        digest = hashlib.sha256(b"\n".join(lines)).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(table):
    rows = conversation_repair.repair(conversation_repair.damaged(conversation_repair.rows_of(table))).collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def odd_conversations():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "assistant", "user"], ["Yes.", "No", "", None, " \n", "Why?", "Yes.", "é ", "Long. " * 50]
    rows = [(k, 0, "user", "Only one.") for k in range(60)]  # some of these lose their only row
    for k in range(100, 160):
        rows += [(rng.choice([k, None]), rng.choice([*range(12), None]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 14))]
    rows += [(900, t // 3, ("user", "assistant")[t % 2], f"Turn {t % 70}.") for t in range(900)]
    rows += [(901, 5, "user", "Same row.")] * 300
    return rows


def test_conversations_against_a_plain_version(spark, data, monkeypatch):
    table = read(spark, data, "conversations")
    assert repaired(table) == plain_conversations([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("audit", F.lit(1)).withColumn("_sha", F.lit("x"))
    want = plain_conversations(rows)
    assert repaired(frame) == want
    assert repaired(frame.limit(0)) == {}


def test_long_conversations_are_hashed_by_a_second_stream(spark, monkeypatch):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    scan = conversation_repair._scan

    def small(batches):
        conversation_repair.HOLD = 1000
        return scan(batches)

    monkeypatch.setattr(conversation_repair, "_scan", small)
    assert repaired(frame) == plain_conversations(rows)


# bottom-k fingerprints
def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_of_whole_and_edited_texts(spark, data):
    table = read(spark, data, "documents")
    rows = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: r for r in bottomk.fingerprints(table).collect()}
    order = sorted(rows, reverse=True)
    assert got.keys() == rows.keys()
    errors = []
    for k, i in enumerate(order):
        text, following = rows[i], rows[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(text), shingles(edited), shingles(following)
        assert len(got[i].fingerprint) == 16 * min(bottomk.K, len(a))
        for near, x, y in ((got[i].near_edited, a, b), (got[i].near_next, a, c)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            if len(x | y) <= bottomk.K:
                assert near == true
            errors.append(abs(near - true))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_fingerprints_of_odd_rows(spark, odd, docs_of):
    rows = bottomk.fingerprints(odd.withColumn("_at", F.lit(1)).withColumn("_sketch", F.lit("x"))).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r.doc_id == 5]
    assert len({r.fingerprint for r in same}) == 2 and all(0 <= r.near_edited <= 1 for r in rows)
    assert [r.fingerprint for r in rows if r.doc_id in (1, 2)] == ["", ""]
    assert bottomk.fingerprints(docs_of([])).count() == 0
    one = bottomk.fingerprints(docs_of(["a single text of some words"])).first()
    assert one.near_next == 1.0  # the next document is itself
    hot = docs_of([(7, f"text {k % 40} of the same id " * 3) for k in range(300)])
    assert bottomk.fingerprints(hot).count() == 300


def test_sketches_merge_and_estimate(spark):
    text = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, text(0, 3000)), (1, text(2000, 6000)), (1, None), (2, text(0, 90)), (2, text(50, 100)), (3, "")]
    parts = spark.createDataFrame(rows, "part int, text string").select("part", bottomk.sketch(F.col("text")).alias("sketch"))
    got = {r.part: r.sketch for r in bottomk.merge_parts(parts, ["part"]).collect()}
    whole = spark.createDataFrame([(1, text(0, 3000) + " " + text(2996, 6000)), (2, text(0, 100)), (3, None)], "part int, text string")
    want = {r.part: r.s for r in whole.select("part", bottomk.sketch(F.col("text")).alias("s")).collect()}
    assert got == want
    pair = spark.createDataFrame([(text(0, 4000), text(1000, 3000))], "a string, b string").select(bottomk.sketch(F.col("a"), k=1024).alias("a"), bottomk.sketch(F.col("b"), k=1024).alias("b"))
    r = pair.select(
        bottomk.resemblance(F.col("a"), F.col("b"), 1024), bottomk.distinct_count(F.col("a"), 1024), bottomk.containment(F.col("b"), F.col("a"), 1024), bottomk.containment(F.col("a"), F.col("b"), 1024),
    ).first()
    for found, true, off in zip(r, (0.5, 3996, 1.0, 0.5), (0.05, 400, 0.1, 0.06)):
        assert abs(found - true) <= off


def test_fingerprints_without_python(spark, data):
    plan = bottomk.query(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# token alignment
@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(public_tokenizers.path(token_alignment.TOKENIZER_A), public_tokenizers.path(token_alignment.TOKENIZER_B))


ODD = ["", None, "  a  b", "a▁b x", " lead", "trail ", "<s> <|endoftext|> x", " x y", "é 😀 a\n\nb  c", "\x1cx y \x85 z", "don't it's a , b", "\x00 nul", "ｆull ﬁ", "x" * 3000, "日本語 テキスト です", " ", "\n", "a" + " " * 40 + "b"]


def plain_alignment(own, text):
    if not text:
        return None
    raw = f" {text}".encode()
    sides = []
    for ids, entries in ((own.a.encode(f" {text}", add_special_tokens=False).ids, own.bytes_a), (own.b.encode(text), own.bytes_b)):
        if b"".join(entries[i] for i in ids) != raw:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(entries[i]), i))
            at += len(entries[i])
        sides.append(spans)
    a, b = sides
    groups, low = [], 0
    for end in sorted({x[1] for x in a} & {x[1] for x in b}):
        groups.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= end) for side in sides))
        low = end
    links, first = [], 0
    for x in a:
        while b[first][1] <= x[0]:
            first += 1
        k = first
        while k < len(b) and b[k][0] < x[1]:
            links.append((x[2], b[k][2]))
            k += 1
    return len(a), len(b), len(groups), ";".join(groups), links


def test_alignment_against_a_plain_version(spark, data, aligner, docs_of):
    texts = [*ODD, *[r.text for r in read(spark, data, "documents").where("n_chars < 3000").collect()]]
    plain = [plain_alignment(aligner, t) for t in texts]
    for text, want, found in zip(texts, plain, aligner.texts(texts)):
        assert (found is None) == (want is None), text
        if want:
            assert found[:4] == want[:4] and sorted((int(p) >> 16, int(p) & 65535) for p in found[4]) == sorted(want[4])
    count, most = {}, {}
    for _, _, _, _, links in filter(None, plain):
        for link in links:
            count[link] = count.get(link, 0) + 1
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    zero = (0, 0, 0, "", [])
    want = sorted(
        (k, *x[:3], len(x[4]), sum(count[p] == most[p[1]] for p in x[4]), sum(count[p] for p in x[4]), hashlib.sha256(x[3].encode()).hexdigest() if x[3] else "")
        for k, x in ((k, x or zero) for k, x in enumerate(plain))
    )
    docs = docs_of(texts).withColumn("pair", F.lit(1)).withColumn("_row", F.lit("x"))
    for most_sent in (token_alignment.BROADCAST_PAIRS, 0):
        got = token_alignment.align(docs, broadcast_pairs=most_sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_alignment_of_odd_rows(spark, odd, docs_of, aligner):
    assert token_alignment.align(odd).count() == odd.count()
    assert token_alignment.align(docs_of([])).count() == 0
    assert token_alignment.products("1,2|3;4|5,6") == [(1, 3), (2, 3), (4, 5), (4, 6)]
    whole = token_alignment.alignments(docs_of(["Some text, twice"]), whole=True).first()
    assert whole.groups == aligner.text("Some text, twice")[3]


def test_alignment_forgets_by_generations(aligner, monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMO", 3)
    own = token_alignment.Aligner(public_tokenizers.path(token_alignment.TOKENIZER_A), public_tokenizers.path(token_alignment.TOKENIZER_B))
    for text in ["one two three four five", "two three six", "one two", "seven eight nine ten two"]:
        assert own.text(text)[:4] == plain_alignment(aligner, text)[:4]
    assert len(own.memo) <= 8
