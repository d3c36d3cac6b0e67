import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wikiloom.llm.packing import INSTRUCTION_LOSS, SEQUENCE, conversation_examples, document_pieces, fill_bins, pack, pack_documents
from wikiloom.llm.pieces import PieceEncoder
from wikiloom.llm.queries import QUERIES
from wikiloom.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, deal string"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "it's don't 'tis", "x.y,z!! (q)", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endof text|>",
    "naïve café ÅÄÖ ß", "日本語 テキスト", "a b  c", "　x y", "tab\tnew\r\nline\x0b\x0cend", "😀😀 ok", "x" * 5000, "word " * 3000, "3.14 1,000 2²", "a\x1cb .\x1c.", "é ​ z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return np.asarray(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_pieces_give_the_librarys_ids(library):
    rng = random.Random(1)
    signs = list("aA bB é.,'!-\n\t$0 9") + ["  ", " \n", " ", "ł", "<|endoftext|>", "'s", "ß"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(3000)]
    encoder = PieceEncoder(PATH, cache_size=50, batch_bytes=200)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got == ids(library, text).tobytes(), repr(text)


def test_columns_are_cut_as_a_whole(library):
    texts = [*ODD, "one", "two.", ".three", "", " four", None, "<|endoftext|>", "five\u2028six", "\u00d7a a\u00d7. a\u00f7! \u00c0\u00ff.", "\x7fa \x00b"]
    column = pa.array([*texts, "cut off"]).slice(0, len(texts))
    ids_, ends = PieceEncoder(PATH).encode_column(column)
    assert [bytes(ids_[a:b]) for a, b in zip([0, *ends], ends, strict=False)] == [ids(library, t).tobytes() for t in texts]
    assert PieceEncoder(PATH).encode_column(column.slice(0, 0))[1].tolist() == []


def test_many_new_pieces_are_few_texts_for_the_library(library):
    class Counted:
        texts = 0

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, batch, **settings):
            self.texts += len(batch)
            return library.encode_batch_fast(batch, **settings)

    encoder = PieceEncoder(PATH)
    encoder.library = Counted()
    rng = random.Random(6)
    words = ["".join(rng.choices("abcd\u00e9\u65e5'", k=9)) for _ in range(5000)]
    assert list(encoder.encode([" ".join(words)])) == [ids(library, " ".join(words)).tobytes()]
    assert encoder.library.texts < 100  # one for each word before
    encoder.lengths = encoder.lengths + 1  # ids that can't be told apart: the pieces go one by one
    assert list(encoder.encode(["".join(f" new{w}" for w in words[:300])])) == [ids(library, "".join(f" new{w}" for w in words[:300])).tobytes()]


def test_counts(spark, library):
    rows = [(i if i % 7 else None, t, "clash", "clash") for i, t in enumerate(ODD + ODD[:4])]
    got = token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    want = sorted((i or -1, len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > 1024) for i, t, *_ in rows)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_packing_is_exact_and_tight(spark, library):
    rng = random.Random(2)
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(1000 + i, " ".join(rng.choices(["the", "tion", "öst", "x1"], k=rng.randint(0, 2500))), None, None) for i in range(300)]
    rows += [(None, "no id", None, None), (5, "a", None, None), (5, "a", None, None)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), PATH).toPandas()
    want = []
    for i, text, *_ in rows:
        own = np.append(ids(library, text), np.uint32(1)).astype("<u4")
        want += [(i if i is not None else -1, s, len(p := own[s : s + SEQUENCE]), zlib.crc32(p.tobytes()), len(own)) for s in range(0, len(own), SEQUENCE)]
    have = got.assign(doc_id=got.doc_id.fillna(-1))[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(int)
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    filled = 0
    for _, rows_ in got.groupby("sequence_id"):
        rows_ = rows_.sort_values("offset")
        assert list(rows_.offset) == list(rows_.length.cumsum() - rows_.length)
        assert rows_.length.sum() <= SEQUENCE
        filled += 1
    assert got.length.sum() / (filled * SEQUENCE) > 0.97
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_bins_hold_all_limits():
    rng = np.random.default_rng(3)
    sizes = np.column_stack([rng.integers(1, 100, 400), rng.integers(0, 60, 400), np.ones(400, int)])
    caps = np.array([100, 60, 8])
    bins, place = fill_bins(sizes, caps)
    for b in np.unique(bins):
        assert (sizes[bins == b].sum(axis=0) <= caps).all()
        assert sorted(place[bins == b]) == list(range((bins == b).sum()))


def test_conversations_respect_loss_limit(spark):
    turns = [(c, t, ("user", "assistant", None)[t % 3], "word " * (30 * (t + 1))) for c in range(40) for t in range(4)] + [(50, 0, "assistant", None)]
    examples = conversation_examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), PATH, 1024, 200)
    packed = pack(examples, {"length": 1024, "loss": 200}, "length", 3).toPandas()
    by = packed.groupby("sequence_id").agg(length=("length", "sum"), loss=("loss", "sum"), n=("conv_id", "count"))
    assert len(packed) == 41 and (by.length <= 1024).all() and (by.loss <= 200).all() and (by.n <= 3).all()


def test_conversations_query(spark, library, tmp_path):
    rng = random.Random(4)
    turns = [(c, t, rng.choices(["assistant", "user", "system", None], [7, 1, 1, 1])[0], " ".join(rng.choices(["the", "tion", "öst"], k=rng.randint(0, 600))), "clash") for c in range(120) for t in range(rng.randint(1, 5))]
    turns += [(500, 0, "assistant", "word " * 5000, "clash"), (501, 0, "user", "word " * 3000, "clash"), (502, 0, None, None, "clash"), (None, 0, "assistant", "a", None), (0, 0, "assistant", "again", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, length string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["packing_conversations"](spark, str(tmp_path)).toPandas()
    want = {}
    for conv, _, role, text, _ in turns:
        n = len(ids(library, text)) + 1
        length, loss = want.get(conv, (0, 0))
        want[conv] = (length + n, loss + n * (role == "assistant"))
    have, parts = {}, {}
    for c, part, n, loss in zip(got.conv_id, got.part, got.length, got.loss, strict=True):
        key = None if np.isnan(c) else int(c)
        length, sum_ = have.get(key, (0, 0))
        have[key] = (length + n, sum_ + loss)
        parts.setdefault(key, []).append(part)
    assert have == want and all(sorted(p) == list(range(len(p))) for p in parts.values())
    assert {c for c, p in parts.items() if len(p) > 1} == {c for c, (n, loss) in want.items() if n > SEQUENCE or loss > INSTRUCTION_LOSS} >= {500, 501}
    by_loss = 0
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist()
        assert rows.length.sum() <= SEQUENCE and rows.loss.sum() <= INSTRUCTION_LOSS
        by_loss += len(rows) > 1 and rows.loss.sum() > INSTRUCTION_LOSS - 200 and rows.length.sum() < SEQUENCE - 200
    assert by_loss  # some sequences are full by loss, with room for tokens
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["packing_conversations"](spark, f"{tmp_path}/none").count() == 0


def test_pieces_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    assert document_pieces(df, PATH).count() == 3
