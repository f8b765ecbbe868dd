"""Packing, codes, token counts and mixing: round trips and brute force, with odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silovalue.llm import codes, common, mixing, ngram_join, packing, piece_counts

BYTES, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id bigint, text string, source string, offset int, size int"
TEXTS = [None, "", "  two  spaces\n\nand lines ", "It's 10,000 a-b <|endoftext|> x", "Straße ünder 漢字 é   z", "word " * 6000, "same", "same", "\x00 nul"]


def frame(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "ab"[i % 2], 1, 2) for i, t in enumerate(TEXTS)], DOCS).repartition(3)


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_workers_give_tokenizers_back_before_a_join():
    common.tokens(WORDS)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a b c d e f"}])
    assert [len(s) for _, s in ngram_join._sets(batch, 5)] == [2] and not common._LOADED


def test_packing_covers_each_id_once(spark):
    pieces = packing.pack(frame(spark), BYTES).toPandas()
    for doc, text in enumerate(TEXTS):
        own, want = pieces[pieces.doc_id == doc].sort_values("start"), ids_of(BYTES, text)
        assert b"".join(own.ids) == want.tobytes()
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {len(want)}
    assert pieces.sequence_id.is_unique and set(pieces.offset) == {0}
    assert all(n & (n - 1) == 0 and n <= 2048 for n in pieces.length)
    assert packing.pack(frame(spark).where(F.lit(False)), BYTES).count() == 0


def test_words_that_the_tokenizer_takes_alike_are_learned_once():
    coder = common.Tokens(WORDS)
    text = "Word word WORD\nwORD (word) word."
    odd = ["H\u0331 h\u0331 \u1e96 K\u0301", "It'S IT's it's", " Two  spaces\tAND Tab ", "\u00c9T\u00c9 \u00e9t\u00e9", "SS <|ENDOFTEXT|> x", ""]
    for got, given in zip(coder.encode(pa.array([text, *odd])), [text, *odd]):
        assert [*got, 1] == ids_of(WORDS, given).tolist()
    coder._clear()
    coder.encode(pa.array([text]))
    assert [w for w in coder.known if w.strip().lower() == "word"] == ["word"]


def test_codes_read_back_what_was_written(spark, tmp_path):
    path = str(tmp_path / "codes")
    codes.write(frame(spark), path, WORDS)
    got = codes.digest(codes.read(spark, path)).orderBy("doc_id").collect()
    whole = [ids_of(WORDS, t) for t in TEXTS]
    starts = np.cumsum([0, *map(len, whole)])
    assert [tuple(r) for r in got] == [(i, int(starts[i]), len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(whole)]
    every = np.concatenate(whole)
    asked = [0, 1, 5, len(every) - 1, 5, len(every) + 9]
    places = spark.createDataFrame([(p,) for p in asked], "place bigint")
    found = sorted(tuple(r) for r in codes.tokens_at(spark, path, places).collect())
    assert found == sorted((p, int(every[p])) for p in asked if p < len(every))


def test_codes_of_no_documents(spark, tmp_path):
    path = str(tmp_path / "codes")
    codes.write(frame(spark).where(F.lit(False)), path, WORDS)
    assert codes.read(spark, path).count() == 0


def test_chunk_levels_address_any_value():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 1 << bits, 700) for bits in (7, 9, 17, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    coded = codes.Codes(*codes.encode(ids))
    assert (coded.all() == ids).all()
    assert all(coded.at(i) == ids[i] for i in range(0, len(ids), 13))


def test_longest_match_equals_trying_every_end():
    end = piece_counts.END
    pieces = [(97,), (97, 98), (97, 98, 99, 100), (98,), (99,), (end,), (100, end)]
    automaton, known, rnd = piece_counts.Automaton(pieces), set(pieces), random.Random(1)
    for _ in range(1500):
        word = bytes(rnd.choice(b"abcde") for _ in range(rnd.randint(1, 9)))
        text, at, count = (*word, end), 0, 0
        while at < len(text):
            to = next((j for j in range(len(text), at, -1) if text[at:j] in known), None)
            if to is None:
                count = 1
                break
            at, count = to, count + 1
        assert automaton.count(word) == count


def test_token_counts_of_odd_rows(spark):
    got = piece_counts.count_tokens(frame(spark), WORDS).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r.n_tokens for r in got}
    assert by[0] == by[1] == 0 and by[6] == by[7] > 0
    assert piece_counts.count_tokens(frame(spark).where(F.lit(False)), WORDS).count() == 0


def test_mixing_meets_its_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 60), rnd.choice(["a", "a", "a", "b", "c", None]), 1, 2) for i in range(3000)]
    rows += [(5000, None, "a", 1, 2), (5001, "", None, 1, 2), (5002, "w " * 4000, "b", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.digest(mixing.mix(docs)).toPandas()
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    of = {i: s for i, _, s, *_ in rows}
    assert dict(zip(mixed.doc_id, mixed["size"])) == sizes
    assert (mixed.taken <= 2 * mixed["size"]).all() and (mixed.taken >= 0).all()
    total = {s: sum(sizes[i] for i in of if of[i] == s) for s in set(of.values())}
    order = sorted(s for s in total if s is not None) + [None]
    want = dict(zip(order, mixing.fill_up(np.array([total[s] for s in order]), np.array([3.0, 1.0, 2.0, 3.0]), 1.5, 2)))
    assert abs(sum(want.values()) - 1.5 * sum(total.values())) < 1e-3
    for s in order:
        own = mixed[[of[d] is s or of[d] == s for d in mixed.doc_id]]
        assert np.allclose(own.target, want[s]) and set(own.source_size) == {total[s]}
        assert abs(own.taken.sum() - want[s]) <= max(60, 0.01 * want[s])
    again = mixing.digest(mixing.mix(docs.repartition(7))).toPandas()
    assert dict(zip(mixed.doc_id, mixed.taken)) == dict(zip(again.doc_id, again.taken))


def test_mixing_nothing(spark):
    assert mixing.mix(frame(spark).where(F.lit(False))).count() == 0


def test_mixing_of_repeated_rows_meets_the_targets(spark):
    rows = [(7, "one two three four five six seven eight nine ten", "a")] * 1000 + [(i, "word " * (i % 40), "b") for i in range(400)] + [(None, "x y", None)] * 90
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    totals = []
    for parts in (7, 3):
        found = mixing.digest(mixing.mix(docs.repartition(parts)))
        by_source = found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
        assert all(abs(r.taken - r.target) <= max(12, 0.02 * r.target) and r.over <= 0 for r in by_source)
        totals.append(sorted((r.source_size, r.taken) for r in by_source))
    assert totals[0] == totals[1]
