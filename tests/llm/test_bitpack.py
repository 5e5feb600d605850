import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vetolex.llm import bitpack
from vetolex.llm.queries import op2

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    raw = bitpack.pack(ids, width)
    assert len(raw) == (1000 * width + 7) // 8
    for a, n in ((0, 1000), (3, 0), (1, 7), (997, 3), (123, 456)):
        assert (bitpack.unpack(raw, width, a, n) == ids[a:a + n]).all()


TEXTS = ["", " ", "a", "a b", " a b ", "a  b", "a\nb c\n\nd", "don't we'll X's", "x\ty z", "a b  c", "<|endoftext|> a<|endoftext|>",
         "é ü 日本 語 123 4.5,6!! ?? a_b", "a\0b c", "tab\there and there", "line one.\nLine two, 'tis\nthree", "\n", "a \n b", "𝔘 🙂 ok   z",
         "word " * 5000 + "end"]


def test_pieces_give_the_ids_of_the_whole(whole):
    encoder = bitpack.PieceEncoder(PATH)
    encoder.SLICE, encoder.BYTES = 7, 40
    for t, ids in zip([*TEXTS, *TEXTS], encoder.encode(pa.array([*TEXTS, *TEXTS]))):
        assert ids.tolist() == whole(t), t
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def brute(rows, whole):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*whole(text), 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_against_whole_texts(spark, small_dir, whole):
    import duckdb
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in op2(spark, small_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute(rows, whole))


def test_edges_and_random_access(spark, make_docs, write_sf, whole, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, None)]
    got = sorted(tuple(r) for r in op2(spark, write_sf(rows)).collect())
    assert got == sorted(brute(rows, whole))
    assert op2(spark, write_sf([])).count() == 0
    assert op2(spark, write_sf([(None, "a b")])).first()["n_tokens"] == 3
    path = str(tmp_path / "packed")
    bitpack.write_packed(make_docs(rows), path, PATH, 50_257, 2, block_ids=64)
    assert [x.tolist() for x in bitpack.document_ids(spark, path, 14)] == [[*whole(TEXTS[14]), 2]]
    assert len(bitpack.document_ids(spark, path, 100)) == 2
    blocks = spark.read.parquet(path)
    assert blocks.where("low <= 14 and high >= 14").count() < blocks.count()
    assert bitpack.document_ids(spark, path, -1) == []


def test_equal_ids_have_one_order_and_null_ids_come_first(spark, make_docs, tmp_path, whole):
    rows = [(7, f"tie {i} " * (1 + i % 3)) for i in range(40)] + [(7, "tie 0 ")] * 3 + [(None, f"none {i}") for i in range(9)] + [(8, None), (6, "before")]
    seen = []
    for i, order in enumerate((rows, rows[::-1], rows[20:] + rows[:20])):
        path = str(tmp_path / f"packed{i}")
        bitpack.write_packed(make_docs(order).repartition(1 + 2 * i), path, PATH, 50_257, 2, block_ids=50)
        seen.append(sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in bitpack.read_packed(spark, path).collect()))
    assert seen[0] == seen[1] == seen[2]
    assert [d for _, d, _, _ in seen[0]] == [None] * 9 + [6] + [7] * 43 + [8]
    assert [a for a, *_ in seen[0]] == [0, *np.cumsum([n for _, _, n, _ in seen[0]])[:-1]]
    lengths = {len(whole(t)) + 1 for d, t in rows if d == 7}
    assert {n for _, d, n, _ in seen[0] if d == 7} == lengths
    assert len(bitpack.document_ids(spark, str(tmp_path / "packed2"), 7)) == 43
