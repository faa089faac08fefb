import glob
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackweave.llm import tokencodec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder(spark):
    """Encodes and decodes lists of bytes with the session's two UDFs."""
    tokencodec.register_coder(spark)

    def run(name, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary").repartition(2)
        return [bytes(r.x) for r in df.select("i", F.expr(f"{name}(v)").alias("x")).orderBy("i").collect()]

    return lambda x: run(tokencodec.ENCODE, x), lambda x: run(tokencodec.DECODE, x)


def test_blocks_round_trip_and_notice_damage(coder):
    encode, decode = coder
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 65536, 300), np.zeros(500), np.tile([7, 8, 9], 100), [65535], [], rng.zipf(1.3, 5000) % 65536, np.arange(20000)]
    ids += [rng.integers(0, 3, 16384), np.repeat(rng.integers(0, 65536, 50), rng.integers(1, 200, 50))]
    given = [np.array(x, "<u2").tobytes() for x in ids]
    coded = encode(given)
    assert decode(coded) == given
    assert len(coded[1]) < 120 and len(coded[2]) < 200 and len(coded[7]) < 16384 * 2.6 / 8
    assert encode([given[2]]) == [coded[2]]  # a block depends on nothing else
    for block, x in zip(coded, given, strict=True):
        n, size, of_ids, of_bytes = struct.unpack_from(tokencodec.BLOCK, block)
        assert (n, size, of_ids, of_bytes) == (len(x) // 2, len(block) - 16, zlib.crc32(x), zlib.crc32(block[16:]))
    for at in (20, len(coded[0]) - 1, 8, 0, 4):
        bad = bytearray(coded[0])
        bad[at] ^= 1
        with pytest.raises(Exception, match="damaged"):
            decode([bytes(bad)])
    with pytest.raises(Exception, match="no head"):
        decode([b"short"])


HARD = ["hello world", None, "", "<|endoftext|> x", "é😀 \n\n", "word " * 3000, "hello world", "a\nb c\nd", " lead", "it's  a  b", "x\x00y", "\x01", "\x02 1", "tab\there"]
HARD += ["a b", "　x", "x\x1cy z", "end\n", "a \nb", "\n", " ", "ß" * 400, "a" * 5000, "\r\nwin\r\n", "ends with <|endoftext|>", "(a) [b] 1,234.5 don't we'll"]


def wanted(rows):
    """By document: ids before it, its ids and their checksum, as the library has them."""
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("rules", [tokencodec.TokenFiles(), tokencodec.TokenFiles(block=128, slice_bytes=10, memo=5), tokencodec.TokenFiles(block=1)])
def test_token_files_equal_the_library(spark, tmp_path, rules):
    rows = list(enumerate(HARD if rules.block > 1 else HARD[:4]))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, ids int, row int, block int").repartition(3)
    folder = f"file://{tmp_path}/tok"
    manifest = tokencodec.write_tokens(docs, folder, PATH, rules=rules)
    assert sorted(tuple(r) for r in tokencodec.read_tokens(manifest, folder).collect()) == wanted(rows)


def test_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = [(None, "no id"), (7, "one"), (-3, "minus"), (7, "two words"), (7, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/tok"
    manifest = tokencodec.write_tokens(docs, folder, PATH)
    got = sorted((tuple(r) for r in tokencodec.read_tokens(manifest, folder).collect()), key=lambda r: r[1])
    assert got == wanted([rows[i] for i in (0, 5, 2, 1, 3, 4)])
    none = tokencodec.write_tokens(docs.limit(0), folder + "0", PATH)
    assert none.count() == 0 and tokencodec.read_tokens(none, folder + "0").count() == 0


def test_other_tokenizers_get_whole_texts_and_large_ids_are_refused(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, t = tokencodec.Words(path, 2, 100), Tokenizer.from_file(path)
    assert not words.cuts
    ids, n = words.ids(pa.array(["Hello  World", None]))
    assert ids.tolist() == [*t.encode("Hello  World", add_special_tokens=False).ids, 2, 2] and n.tolist() == [len(ids) - 1, 1]
    with pytest.raises(ValueError, match="65536"):
        tokencodec.TokenFiles(end_id=1 << 16)


def test_files_cut_short_are_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder, rules = f"file://{tmp_path}/tok", tokencodec.TokenFiles(block=256)
    manifest = tokencodec.write_tokens(docs, folder, PATH, rules=rules)
    (path,) = glob.glob(f"{tmp_path}/tok/*.tok")
    data = open(path, "rb").read()
    size = struct.unpack_from(tokencodec.BLOCK, data, 8)[1]
    with open(path, "wb") as f:
        f.write(data[:8] + data[8 + 16 + size :])  # without its first block
    with pytest.raises(Exception, match="ends before its last document"):
        tokencodec.read_tokens(manifest, folder).count()


def test_a_task_lets_go_of_the_texts_it_has_encoded():
    import pyarrow as pa

    held = []

    def batches():
        for k in range(40):
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["some words " * 100_000])], names=["id", "text"])
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()  # its columns share one buffer, as those from Spark do
            del sink, batch
            held.append(pa.total_allocated_bytes())

    for _ in tokencodec._tokens(PATH, tokencodec.TokenFiles())(batches()):
        pass
    assert len(held) == 40 and held[-1] - held[1] < 8 << 20  # 1.1 MB a text


def test_workers_get_bounded_batches_and_small_tables_have_few_parts(spark, tmp_path, monkeypatch):
    def noted(name, own):
        def run(batches):
            def sizes():
                for batch in batches:
                    with open(f"{tmp_path}/{name}", "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return own(sizes())

        return run

    tokens = tokencodec._tokens
    monkeypatch.setattr(tokencodec, "_tokens", lambda *given: noted("tokens", tokens(*given)))
    monkeypatch.setattr(tokencodec, "_documents", noted("documents", tokencodec._documents))
    rows = [(i, f"{i} " + "some words " * 15_000) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/tok"
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    manifest = tokencodec.write_tokens(docs, folder, PATH)
    out = tokencodec.read_tokens(manifest, folder)
    assert spark.conf.get(key, None) == before
    assert sorted(tuple(r) for r in out.collect()) == wanted(rows)
    for name, longest in (("tokens", 170_000), ("documents", 33_000)):
        sizes = [int(x) for x in open(f"{tmp_path}/{name}")]
        assert sum(sizes) > 8 << 20 and max(sizes) < (4 << 20) + 2 * longest, name
    parts = lambda df: glob.glob(df.trackweave_path.removeprefix("file://") + "/*.parquet")
    assert len(parts(manifest)) == 1 and len(parts(out)) <= 2
    many = tokencodec.write_tokens(docs.repartition(20), folder + "20", PATH)
    assert many.count() == 20 and len(parts(many)) == 1


def test_words_of_letters_skip_the_search_for_pieces():
    import pyarrow as pa
    from tokenizers import Tokenizer, pre_tokenizers

    signs = tokencodec.byte_signs()
    assert len(set(signs)) == 256 and set(signs) == set(pre_tokenizers.ByteLevel.alphabet())
    for b, text in ((10, "\n"), (32, " "), (65, "A")):
        assert pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)[0][0] == signs[b]
    words, t = tokencodec.Words(PATH, 2, 1000), Tokenizer.from_file(PATH)
    seen = []
    several = words._several
    words._several = lambda given: seen.extend(given) or several(given)
    letters = [chr(x) for x in range(0xC0, 0x250) if x not in (0xD7, 0xF7)]
    texts = ["one " + "two three " * 3 + "straße", "x " + " ".join(a + "b" + a for a in letters), "a × b ÷ c ª º µ", "don't we'll 're", "a1 b22 c_d ɐ 漢字 é", "a\nÉté b\nc", "", "\n", " Ż"]
    ids, n = words.ids(pa.array(texts))
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert " two" not in seen and " straße" not in seen and " ÀbÀ" not in seen and " ×" in seen and " c_d" in seen and "one" in seen
