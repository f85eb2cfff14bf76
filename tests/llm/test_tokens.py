import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoor.llm import packing, storage, token_orc
from spoor.llm.queries import QUERIES
from spoor.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = st.text(st.sampled_from("aB'sé ßİ1 29\n\r\t  \x1c\x85—日<|>!?.Σς́x"), max_size=40)


def ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


WHOLE = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.sampled_from([WORD, BYTE]))
def test_pieces_give_the_whole_texts_ids(text, path):
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == WHOLE[path].encode(text, add_special_tokens=False).ids


def check_positions(rows, texts):
    at = 0
    by_id = {r.doc_id: r for r in rows}
    for doc in sorted(texts):
        own = [*WHOLE[WORD].encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        assert (by_id[doc].start, by_id[doc].n_tokens, by_id[doc].ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_orc_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_token_orc"](spark, sf).collect()
    assert len(rows) == len(texts)
    check_positions(rows, texts)


def test_orc_odd_rows_and_point_read(spark, odd_docs):
    path = storage.new_path(spark, "t")
    token_orc.write(odd_docs, path, WORD)
    rows = token_orc.positions(spark, path).collect()
    assert len(rows) == odd_docs.count()
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and min(rows, key=lambda r: r.start).doc_id is None
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert {r.doc_id for r in token_orc.read(spark, path, [5]).collect()} == {5}
    empty = storage.new_path(spark, "t")
    token_orc.write(odd_docs.limit(0), empty, WORD)
    assert token_orc.positions(spark, empty).count() == 0


def check_packing(rows, texts, limit=1024, segments=256):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    waste = 0
    for pieces in sequences.values():
        pieces.sort()
        at = 0
        for offset, length in pieces:
            assert offset == at and length > 0
            at += length
        assert at <= limit and len(pieces) <= segments
        waste += 0 if at & (at - 1) == 0 else limit - at
    for doc, text in texts.items():
        own, at = [*WHOLE[BYTE].encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    return waste


def test_packing_is_exact_and_full(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packing(QUERIES["op9_packing"](spark, sf).collect(), texts) == 0


def test_packing_odd_rows(spark, odd_docs):
    once = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(once, BYTE).collect(), {r.doc_id: r.text for r in once.collect()})
    assert packing.pack(odd_docs, BYTE).groupBy().sum("length").first()[0] > 0
    assert packing.pack(odd_docs.limit(0), BYTE).count() == 0


def test_packing_limits_on_segments_and_loss(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40 + 1), 0 if i % 2 else 5) for i in range(300)], "doc_id long, text string, loss_from long").coalesce(1)
    rows = packing.pack(docs, BYTE, max_tokens=64, max_segments=3, max_loss=40, bins=8).collect()
    lost = {i: 0 if i % 2 else 5 for i in range(300)}
    loss, count = defaultdict(int), defaultdict(int)
    for r in rows:
        loss[r.sequence_id] += max(0, min(r.start + r.length, r.doc_tokens - 1) - max(r.start, lost[r.doc_id]))
        count[r.sequence_id] += 1
    assert max(loss.values()) <= 40 and max(count.values()) <= 3
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 64, 3)


def test_other_tokenizer_files_are_used_whole(tmp_path):
    told = json.loads(WHOLE[BYTE].to_str())
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    texts = ["two words", " it's 12 a\n\nb", "日本 x"]
    assert [np.frombuffer(encoder(str(path)).encode(t), "<u4").tolist() for t in texts] == [ids(str(path), t) for t in texts]
    assert encoder(BYTE).byte and encoder(WORD).word and not encoder(str(path)).byte


def test_limits_bind_and_leave_no_padding():
    rng = np.random.default_rng(2)
    packer = packing.Packer(0, 64, 4, 48, 6)
    sizes = rng.choice([1, 2, 3, 9, 30, 64, 65, 300], 400)
    for doc, n in enumerate(sizes.tolist()):
        packer.add(packing.Piece(doc, bytes(4 * n), 0, 0, n, n, n // 4))
    packer.finish()
    at, loss, count, length = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for doc, start, size, _, total, sequence, offset in sorted(packer.out, key=lambda r: (r[0], r[1])):
        assert start == at[doc] and total == sizes[doc]
        at[doc] += size
        loss[sequence] += max(0, min(start + size, total - 1) - max(start, total // 4))
        count[sequence] += 1
        length[sequence] += size
    assert at == {d: n for d, n in enumerate(sizes)}
    assert max(loss.values()) == 48 and max(count.values()) == 4 and all(n == 64 or n & (n - 1) == 0 for n in length.values())
