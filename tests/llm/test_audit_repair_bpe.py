"""Byte-level BPE against its library, the filter audit against filtering in each order, repairs against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib
from math import factorial

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from silovalue.llm import byte_bpe, chat_repair, filter_audit

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def random_text(r):
    kinds = (
        lambda: "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x3040, 0x30FF), r.randrange(0x1F300, 0x1F700)])) for _ in range(r.randrange(60))),
        lambda: "".join(r.choice("abcdeaeiou  \n\t's") for _ in range(r.randrange(200))),
        lambda: "".join(r.choice(["a", "aa", " ", "\n", "the", "ing", "é", "\x1c", "\x85", "1", "00", "!!", "--"]) for _ in range(r.randrange(300))),
        lambda: "".join(chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in (r.randrange(0x110000) for _ in range(r.randrange(40)))),
    )
    return r.choice(kinds)()


def test_transducer_gives_what_the_library_gives(library):
    encoder, decoder = byte_bpe.coders(RANKS, PATTERN)
    small = byte_bpe.Transducer(byte_bpe.load_ranks(RANKS), most_states=50)  # forgets again and again
    r = random.Random(5)
    for _ in range(1500):
        text = random_text(r)
        want = library.encode_ordinary(text)
        assert encoder.encode(text).tolist() == want
        assert [t for piece in encoder.pattern.findall(text) for t in small.encode(piece.encode())] == want
        assert byte_bpe._decoded(decoder, encoder.encode(text)) == text


def test_long_pieces_are_settled_on_the_way(library):
    encoder, _ = byte_bpe.coders(RANKS, PATTERN)
    for text in ("a" * 30_000, " " * 20_000 + "x", "ab" * 9_000, "é" * 8_000, "=" * 10_000, "qwertyuiopasdfghjklzxcvbnm" * 400):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_ranks_that_do_not_rise_run_the_merges():
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 1, b"ab": 300, b"bc": 301, b"ca": 302, b"abab": 2, b"cc": 3, b"xyz": 303}
    made = byte_bpe.Transducer(ranks)
    r = random.Random(2)
    for _ in range(3000):
        piece = "".join(r.choice("abcxyz") for _ in range(r.randrange(1, 14))).encode()
        want = [ranks[piece]] if piece in ranks else [ranks[p] for p in byte_bpe.merge_bytes(ranks, piece)]
        assert made.encode(piece) == want, piece


def test_decoder_gives_whole_characters_only():
    decoder = byte_bpe.StreamDecoder([bytes([b]) for b in range(256)])
    data = "aé漢😀z".encode()
    given = [decoder.feed([b]) for b in data]
    assert "".join(given) == "aé漢😀z" and given[1] == "" and given[2] == "é" and decoder.finish() == ""
    r = random.Random(1)
    for _ in range(3000):
        data = bytes(r.choice([r.randrange(256), r.randrange(0x80, 0xC0), 0xE2, 0x82, 0xED, 0xF0, 0x41]) for _ in range(r.randrange(12)))
        cuts = sorted(r.choices(range(len(data) + 1), k=2))
        got = "".join(decoder.feed(part) for part in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :])) + decoder.finish()
        assert got == data.decode(errors="replace")


def test_round_trip_of_odd_rows(spark, library):
    texts = [None, "", "same text", "same text", " \n ", "<|endoftext|>", "word " * 30_000, "ñandú 漢字"]
    rows = [(i if i != 4 else None, t, "x", 7) for i, t in enumerate(texts)] + [(2, "other", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int").repartition(3)
    got = byte_bpe.digest(byte_bpe.round_trip(docs, RANKS, PATTERN)).collect()

    def line(doc, text):
        ids = library.encode_ordinary(text or "")
        return (doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    assert sorted(map(tuple, got), key=str) == sorted((line(d, t) for d, t, *_ in rows), key=str)
    coded = byte_bpe.encode(docs, RANKS, PATTERN)
    back = byte_bpe.decode(coded.unionByName(spark.createDataFrame([(99, None)], "doc_id bigint, ids array<int>")), RANKS, PATTERN)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(d, t or "") for d, t, *_ in rows] + [(99, "")], key=str)
    assert byte_bpe.digest(byte_bpe.round_trip(docs.where(F.lit(False)), RANKS, PATTERN)).count() == 0


def audit_by_filtering(rows, labels):
    marks = {}
    for doc, quality, toxic in labels:
        good, bad = marks.get(doc, (0, 0))
        marks[doc] = (max(good, quality == 1), max(bad, toxic == 1))
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    flagged = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and least[text] < doc}
        flagged.append((lang or "", {f for f, bad in fails.items() if bad}, *(marks.get(doc, (0, 0)) if doc is not None else (0, 0))))
    out = {}
    for part in {p for p, *_ in flagged}:
        own = [f for f in flagged if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {k: tuple(int(x) for x in v) for k, v in out.items()}


def test_filter_audit_equals_filtering_in_each_order(spark):
    r = random.Random(8)
    pool = [" ".join(r.choices([f"w{i}" for i in range(200)], k=r.choice([50, 99, 100, 130]))) for _ in range(25)]
    pool += ["SHOUT " * 120, "a b " * 60, "costs 5 $ " + pool[0], None, "", " \x1c ", "x" * 300_000]
    rows = [(r.choice([i, i, i // 2, None]), r.choice(pool), r.choice(["en", "fr", "", None])) for i in range(160)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in r.choices(range(160), k=90)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id bigint, text string, lang string, part int, mask string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(filter_audit.cells(docs, table)).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x[3:]) for x in got} == audit_by_filtering(rows, labels)
    assert len(got) == 3 * 120 * 5
    assert filter_audit.audit(filter_audit.cells(docs.where(F.lit(False)), table)).count() == 0
    assert filter_audit.audit(filter_audit.cells(docs, table.where(F.lit(False)))).agg(F.sum("good_lost")).first()[0] == 0


def test_gray_walk_equals_each_subset_by_itself():
    rng = np.random.default_rng(3)
    mask, counts = np.arange(16), rng.integers(0, 50, (16, 3))
    states = filter_audit.survivors(mask, counts, 4)
    for subset in range(16):
        assert (states[subset] == counts[(mask & subset) == 0].sum(axis=0)).all()
    steps = list(filter_audit.orders(states, "ABCD"))
    assert len(steps) == 4 * factorial(4)


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Tries every list of edits with at most three insertions."""
    best = [None]

    def go(i, roles, cost, audit, out, inserted):
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(rows) and LEGAL.match(roles):
            best[0] = min(best[0] or (cost, audit, out), (cost, audit, out))
        if inserted < 3:
            for t, name in (("u", "user"), ("a", "assistant")):
                go(i, roles + t, cost + 5, audit + "I", (*out, (name, "")), inserted + 1)
        if i < len(rows):
            role, text, unwanted, truncated = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", out, inserted)
            if not unwanted:
                stay = cost + 5 * truncated
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, roles + role[:1], stay, audit + "K", (*out, (role, text)), inserted)
                for t, name in (("u", "user"), ("a", "assistant")):
                    go(i + 1, roles + t, stay + 1, audit + "R", (*out, (name, text)), inserted)

    go(0, "", 0, "", (), 0)
    return best[0]


def repair(rows):
    made = chat_repair.Repair()
    out = [x for row in rows for x in made.row(*row)] + list(made.end())
    return made.cost, "".join(e for e, _, _ in out), tuple((role, text) for e, role, text in out if e != "D")


@pytest.mark.parametrize("open_rows", [1, 2, 64])
def test_repair_equals_trying_all_edits(monkeypatch, open_rows):
    monkeypatch.setattr(chat_repair, "OPEN_ROWS", open_rows)
    r = random.Random(open_rows)
    for _ in range(250):
        rows = [(r.choice(["system", "user", "assistant", "user", "tool", ""]), f"t{i}", r.random() < 0.15, r.random() < 0.2) for i in range(r.randrange(6))]
        assert repair(rows) == cheapest(rows)


def test_long_conversations_are_settled_on_the_way():
    made, r, most = chat_repair.Repair(), random.Random(1), 0
    for i in range(20_000):
        list(made.row(r.choice(["user", "assistant", "system"]), "x", r.random() < 0.1, r.random() < 0.1))
        most = max(most, len(made.open))
    assert most < 1_000


def report_by_hand(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in damaged.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [t for t, _, _ in kept if t is not None]
        counts, seen, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in kept:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, said = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_report_of_damaged_rows(spark):
    r = random.Random(11)
    rows = []
    for conv in [*range(120), None]:
        turns = [r.choice([i, i, i, i + 1, None]) for i in range(r.randrange(1, 6))]
        rows += [(conv, t, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Yes.", "No", "Why?", " ", None, "", "é.\n", "." * 5])) for t in turns]
    frame = spark.createDataFrame([(*x, "z", 3) for x in rows], "conv_id bigint, turn bigint, role string, text string, present string, seen int").repartition(5)
    damaged = chat_repair.damage(frame)
    assert sorted(map(tuple, chat_repair.report(damaged).collect()), key=str) == report_by_hand(rows)
    turns = chat_repair.repaired(damaged).orderBy("conv_id", "place").collect()
    for conv in {x.conv_id for x in turns}:
        assert LEGAL.match("".join(x.role[:1] for x in turns if x.conv_id == conv))
    assert chat_repair.report(chat_repair.damage(frame.where(F.lit(False)))).count() == 0


def test_a_conversation_whose_rows_are_all_dropped(spark):
    dropped = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*dropped, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    got = chat_repair.report(chat_repair.damage(frame)).collect()
    assert [tuple(x) for x in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
