import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemora.llm.packing import pack, pack_documents
from mnemora.llm.tokenids import ShardReader, read_token_shards, token_ids, write_token_shards
from mnemora.llm.tokens import encoder
from tests.llm.cases import documents, empty, rows_of, texts

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def segments(name, some):
    raw = [t.encode() for t in some]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, bounds = encoder(public_tokenizers.path(name)).encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(some=st.lists(st.text(alphabet=st.sampled_from("aB é\n\t.,'’0-9ß漢   \x01<|endoftext|>!s're"), max_size=40), min_size=1, max_size=4))
def test_segments_equal_the_tokenizer(name, some):
    assert segments(name, some) == [plain(name)(t) for t in some]


@pytest.mark.parametrize("name", NAMES)
def test_segments_on_documents(spark, name):
    some = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    some += [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(10).collect()]
    one = plain(name)
    assert segments(name, some) == [one(t) for t in some]


def test_token_ids(spark):
    docs = documents(spark, 7, 45)
    one, start, want = plain(NAMES[0]), 0, []
    for k, t in sorted(texts(docs).items()):
        ids = one(t) + [1]
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows_of(token_ids(docs), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_ids(empty(spark)).count() == 0


def test_files_give_random_access(spark, tmp_path):
    docs = documents(spark, 8, 30)
    folder = f"file://{tmp_path}/shards"
    index = write_token_shards(docs, folder, public_tokenizers.path(NAMES[0]), 64)
    file = index.first().file
    reader = ShardReader(folder, file, 64)
    table = pa.ipc.open_file(pa.memory_map(f"{tmp_path}/shards/{file}")).read_all()
    assert table.schema.field("input_ids").type == pa.list_(pa.uint16(), 64)
    ids, mask = reader.sequence(1)
    assert ids.tolist() == table["input_ids"][1].as_py() and mask.tolist() == table["attention_mask"][1].as_py()
    used = sum(r.n_tokens for r in index.where(index.file == file).collect())
    assert sum(sum(m.as_py()) for m in table["attention_mask"]) == used
    assert read_token_shards(index, folder, 64).count() == docs.count()


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 200), min_size=1, max_size=60))
def test_pack_places_every_token_once(lengths):
    capacity = 64
    at, docs = defaultdict(list), defaultdict(list)
    for d, start, n, sequence, offset in pack(np.array(lengths), capacity):
        docs[d].append((start, n))
        at[sequence].append((offset, n))
    for d, n in enumerate(lengths):
        edge = 0
        for start, size in sorted(docs[d]):
            assert start == edge
            edge += size
        assert edge == n
    for parts in at.values():
        edge = 0
        for offset, n in sorted(parts):
            assert offset == edge
            edge += n
        assert edge <= capacity and (edge == capacity or edge & (edge - 1) == 0)


def test_pack_balances_cost():
    from mnemora.llm.packing import cost

    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 64, 400)
    load = defaultdict(float)
    for _, _, n, sequence, _ in pack(lengths, 64):
        load[sequence] += cost(n, 1, 1 / 64)
    full = sorted(load.values())[len(load) // 10 :]
    assert max(full) < 2.2 * min(full)


def test_packed_documents(spark):
    docs = documents(spark, 9, 45)
    one = plain(NAMES[1])
    ids = {k: one(t) + [1] for k, t in texts(docs).items()}
    rows = pack_documents(docs, group_tokens=3000).collect()
    size = defaultdict(int)
    parts = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        parts[r.sequence_id].append((r.offset, r.length))
        size[r.doc_id] += r.length
    assert size == {k: len(v) for k, v in ids.items()}
    for p in parts.values():
        edge = 0
        for offset, n in sorted(p):
            assert offset == edge
            edge += n
        assert edge == 2048 or edge & (edge - 1) == 0
    assert pack_documents(empty(spark)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = documents(spark, 9, 12)
    total = lambda df: sum(r.length for r in pack_documents(df).collect())
    assert total(docs.union(docs)) == 2 * total(docs)
