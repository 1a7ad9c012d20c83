"""Conversation repair, secret scan and fill in the middle against plain Python."""

import collections
import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from folioscan.llm import conversation_repair as repairs  # noqa: E402
from folioscan.llm import fill_middle, secret_scan  # noqa: E402
from folioscan.llm.common import read_table  # noqa: E402
from folioscan.llm.queries import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, cost int, audit string, `head` int"
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def told(rows):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


# ---- conversation repair


def test_op11_on_whole_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        want = {conv: brute.repaired(own) for conv, own in brute.damaged(rows).items()}
        got = queries()["op11_conversation_repair"](spark, sf).collect()
        assert len(got) == len(want) and told(got) == want
    assert sum(w[5] > 0 for w in want.values()) > 20


@pytest.mark.parametrize("seed", range(3))
def test_programme_equals_the_search_backwards(seed):
    rng = random.Random(seed)
    programme = repairs.Programme()
    faults = ("", "blank", "duplicate", "truncated")
    made = sorted({tuple((rng.choice("suato"[: rng.randint(2, 5)]), rng.choices(faults, (6, 1, 1, 2))[0]) for _ in range(rng.randint(0, 12))) for _ in range(3000)})
    signed = {"".join(repairs.sign("sua".find(r) if r in "sua" else 3, faults.index(f)) for r, f in own): own for own in made}
    for signature in sorted(signed):
        assert programme.answer(signature) == brute.cheapest_edits(tuple(signed[signature])), signed[signature]
    assert len(programme.layers) < 500


def test_programme_shares_prefixes_and_keeps_few_layers():
    programme = repairs.Programme()
    u, a, blank = repairs.sign(1, 0), repairs.sign(2, 0), repairs.sign(1, 1)
    long = (u + a) * 100_000
    assert programme.answer(long) == (0, "K" * 200_000)
    start = time.time()
    for k in range(200):
        assert programme.answer(long + blank * (k % 3)) == (2 * (k % 3), "K" * 200_000 + "D" * (k % 3))
    assert time.time() - start < 30
    assert programme.answer(blank * 50_000)[0] == 100_000 and len(programme.layers) < 100
    assert programme.answer("") == (0, "")


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "assistant", "Early."), (1, None, None, None), (1, 7, "assistant", "Late!"),
        (2, None, "user", "Only."), (3, 5, "system", "S."), (4, 1, "", "x."), (4, 2, "tool", "y."), (4, 2, "assistant", "z"), (None, 1, "user", "n."), (None, 2, "assistant", "m."),
        (5, 3, "user", "b."), (5, 3, "user", "a."), (5, 4, "assistant", " \x0b\t"), (5, 9, "Assistant", "ä?\n"), (6, 2**60, "user", "w " * 60_000 + "."), (6, -(2**60), "user", "w " * 60_000 + "!"),
        (7, 1, "user", "é" * 150 + "b."), (7, 1, "user", "é" * 150 + "a."),
    ]
    got = told(repairs.repair(turns(spark, rows)).collect())
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    mark = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:100], hashlib.sha256(t[2].encode()).digest())
    assert got == {conv: brute.repaired(sorted(t, key=mark)) for conv, t in own.items()}
    assert got[6][0] == 2**61 - 1 and got[2][5:7] == (2, "D")
    assert repairs.repair(turns(spark, [])).count() == 0


def test_copies_and_conversations_without_turns(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", 2), (1, 2, "assistant", "b.", 1), (2, 1, "user", "a.", 0), (3, 1, "user", "c.", None)], "conv_id int, turn int, role string, text string, n int")
    got = told(repairs.repair(rows, copies_col="n").collect())
    assert got == {1: brute.repaired([(1, "user", "a."), (1, "user", "a."), (2, "assistant", "b.")]), 2: NOTHING, 3: NOTHING}


def test_a_conversation_of_many_turns_is_spread_and_streamed(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    one = repairs.repair(rows).first()
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i}." for i in range(30_000))
    assert (one.gaps, one.cost, one.audit) == (0, 0, "K" * 30_000) and one.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repaired_turns_are_the_text_of_the_digest(spark):
    source = repairs.damage(read_table(spark, SF, "conversations"))
    want = {conv: own[-1] for conv, own in told(repairs.repair(source, copies_col="copies").collect()).items()}
    lines = collections.defaultdict(list)
    for r in repairs.repaired_turns(source, copies_col="copies").orderBy("conv_id", "position").collect():
        assert r.position == len(lines[r.conv_id]) and r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha for conv, sha in want.items())


# ---- secrets


def crc_token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    return prefix + body + digits


GITHUB, NPM = crc_token("ghp_", "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy"), crc_token("npm_", "0123456789abcdefghijABCDEFGHIJ")
# Public examples: test vectors of hierarchical keys and of key encodings.
XPRV = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
NSEC = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"


def test_op12_on_whole_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
        rows = queries()["op12_secret_scan"](spark, sf).collect()
        assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == {k: brute.secret_row(t) for k, t in texts.items()}
    assert sum(r.n_assign + r.n_hex for r in rows) > 5


def test_base_spans_on_random_texts():
    rng = random.Random(5)
    scanner = secret_scan.Scanner()
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "Api__key", "=", ":", " ", "  ", '"', "'", "AKIA", "akia", "ABCDEFGH12345678", "Z", "abcdef", "0123456789", "deadbeef" * 3, "F", "ſecret", "toKen", "é", "😀", "\n", "-", "/", "x.y"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        raw = text.encode()
        assert secret_scan.in_code_points(raw, scanner.spans(raw)) == brute.base_secrets(text), text


def kinds_of(text):
    return [(secret_scan.KINDS[k], text.encode()[a:b].decode()) for a, k, b in secret_scan.Scanner().spans(text.encode())]


def test_checksums_decide():
    assert kinds_of(f"use {GITHUB} and {NPM}, {XPRV}; {NSEC} or {NSEC.upper()}") == [("github", GITHUB), ("npm", NPM), ("xprv", XPRV), ("nsec", NSEC), ("nsec", NSEC.upper())]
    age = "AGE-SECRET-KEY-1" + "Q" * 58
    for bad in (GITHUB[:-1] + "!", GITHUB[:10] + "z" + GITHUB[11:], GITHUB + "x", NPM.lower(), XPRV[:-1] + "1", "xprv" + "z" * 107, NSEC[:-1] + "q", NSEC.replace("vl", "VL"), age, "ghp_", "nsec1"):
        assert kinds_of(bad) == [], bad
    assert kinds_of("xghp_" + GITHUB) == [("github", GITHUB)]
    assert kinds_of(f'token = "{GITHUB}"') == [("assign", f'token = "{GITHUB}'), ("github", GITHUB)]


def test_bech32_of_a_made_key():
    data = [(7 * i + 3) % 32 for i in range(52)]
    name = "age-secret-key-"
    spread = [*(ord(c) >> 5 for c in name), 0, *(ord(c) & 31 for c in name)]
    check = 1
    for v in [*spread, *data, *[0] * 6]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    check ^= 1
    key = (name + "1" + "".join("qpzry9x8gf2tvdw0s3jn54khce6mua7l"[v] for v in [*data, *((check >> 5 * (5 - i)) & 31 for i in range(6))])).upper()
    assert kinds_of(key) == [("age", key)] and kinds_of(key[:-1] + ("Q" if key[-1] != "Q" else "P")) == []


def test_secrets_of_odd_rows(spark):
    schema = "doc_id bigint, text string, spans string, kind string, id int"
    rows = [(1, None), (2, ""), (None, "é token: abcdef 😀 " + "a1" * 12), (3, "SECRET='xxxxxx'"), (3, "SECRET='xxxxxx'"), (4, "x " * 200_000 + "passwd=123456"), (5, "token" * 60_000), (6, "password" + " " * 100_000 + "x"), (7, "a" * 300_000)]
    found = secret_scan.find_secrets(spark.createDataFrame([(*r, "s", "k", 9) for r in rows], schema))
    assert found.columns == ["doc_id", "spans"]
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in found.collect()]
    want = [(k, [(("assign", "access", "hex")[n], a, b) for a, n, b in brute.base_secrets(t)]) for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert secret_scan.find_secrets(spark.createDataFrame([], schema)).count() == 0


def test_masked(spark):
    rows = spark.createDataFrame([(1, f"é token: {GITHUB}, ok"), (2, "plain"), (3, "deadbeef" * 4), (4, "")], "doc_id int, text string")
    out = secret_scan.find_secrets(rows).join(rows, "doc_id").select("doc_id", secret_scan.masked(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "é [secret], ok", 2: "plain", 3: "[secret]", 4: ""}


# ---- fill in the middle


def test_op13_on_whole_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
        rows = queries()["op13_fill_in_middle"](spark, sf).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: brute.middle_row(k, t) for k, t in texts.items()}
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_middle_of_odd_rows(spark):
    schema = "doc_id bigint, text string, output string, form string, id int, made int"
    rows = [(1, None), (2, ""), (None, "a b"), (3, " \n\t "), (3, " \n\t "), (4, "x<P>y z"), (5, "😀 é\x0b w w "), (6, "w " * 300_000), *((k, f" a{k}  bé\nc \x0c d") for k in range(10, 60))]
    docs = spark.createDataFrame([(*r, "o", "f", 1, 2) for r in rows], schema)
    got = fill_middle.fill_in_middle(docs).collect()
    texts = collections.defaultdict(list)
    for k, t in rows:
        texts[k].append(t or "")
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == brute.middle_row(r.doc_id, texts[r.doc_id][0])
        assert fill_middle.rebuild(r.output, r.form) == texts[r.doc_id][0]
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_can_be_rebuilt(form):
    text = " a b\n c  "
    ends = fill_middle.unit_ends(text)
    for a in range(len(ends) + 1):
        for b in range(len(ends) + 1):
            got, output, *_ = fill_middle.arrange(text, ends, [a, b, 0, 0 if form == "spm" else 99], 50, 80)
            assert got == form and fill_middle.rebuild(output, form) == text
