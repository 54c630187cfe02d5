"""SentencePiece encoding against the library: ids, spans, decoded texts."""

import hashlib
import random

import numpy as np
import pytest

from trailweave.llm import sentencepiece_codec as S
from trailweave.llm.common import importable
from trailweave.llm.queries import TOKENIZERS

spm = pytest.importorskip("sentencepiece")
pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def _texts(n=600, seed=1):
    r = random.Random(seed)
    letters = list("aábcdeéfgh ijklmnoprstu  \n\t.,-'123 ") + list("日本語한국어🙂▁É́fiﬁ①　½ﾊﾟé̀\x00  \xa0ａＢ")
    some = ["", " ", "  ", "▁", "a ▁ ", " a", "a ", "\n", "hello world", "a" * 400, " " * 100, "a " + " " * 50 + "b", "xﬁ ﬁ", "각"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)] + some


def _changed(**changes):
    """The model file with fields of its normaliser or trainer set."""
    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    for k, v in changes.items():
        if k == "rule":
            q = pb.ModelProto()
            q.ParseFromString(spm.SentencePieceNormalizer(rule_name=v).serialized_model_proto())
            proto.normalizer_spec.precompiled_charsmap = q.normalizer_spec.precompiled_charsmap
        elif k == "kinds":
            for piece in proto.pieces:
                piece.type = v.get(piece.piece, piece.type)
        elif hasattr(proto.normalizer_spec, k):
            setattr(proto.normalizer_spec, k, v)
        else:
            setattr(proto.trainer_spec, k, v)
    return proto.SerializeToString()


def _agree(raw, texts):
    own, library = S.Model(raw), spm.SentencePieceProcessor(model_proto=raw)
    raws = [t.encode() for t in texts]
    ids, begin, end, count = own.encode(raws)
    decoded, at = own.decode(ids.astype(np.int64), count), 0
    for text, source, n, said in zip(texts, raws, count, decoded):
        want = library.encode(text, return_type="proto").pieces
        assert ids[at : at + n].tolist() == [p.id for p in want], text
        assert list(zip(begin[at : at + n].tolist(), end[at : at + n].tolist())) == [(p.begin, p.end) for p in want], text
        assert said.decode() == library.decode([p.id for p in want]), text
        at += n
    return own, library


def test_model_as_it_is():
    own, library = _agree(_changed(), _texts())
    r = random.Random(2)
    for _ in range(400):  # any ids, bytes that are no UTF-8 among them
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), own.id["▁"], 0, 1]) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        own.decode(np.array([32000]), np.array([1]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps(rule):
    for prefix, squeeze in ((True, True), (True, False), (False, True), (False, False)):
        _agree(_changed(rule=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze), _texts(150, 3))


def test_other_settings():
    _agree(_changed(byte_fallback=False, kinds={f"<0x{i:02X}>": 5 for i in range(256)}), _texts(200, 4))
    _agree(_changed(kinds={"llo": 4, "▁wor": 4, "aa": 4, "hi": 4}), [*_texts(200, 5), "hello world", "▁worhi", "aaaaa hill", "xhix"])
    _agree(_changed(kinds={"▁hello": 5, "▁world": 5, "aa": 5, "aaaa": 5, "lo": 5}), [*_texts(200, 6), "hello world hello"])
    _agree(_changed(kinds={"hi": 4}, rule="nfkc"), [*_texts(100, 7), "xhiﬁhi"])


def test_long_texts_in_windows(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 40)
    r = random.Random(8)
    long = ["".join(_texts(60, k)) for k in range(4)] + [" ".join("w" * r.randint(1, 9) for _ in range(400)), "x" * 3000, "日本" * 800, "a  " * 300 + "   "]
    for raw in (_changed(), _changed(rule="nmt_nfkc", remove_extra_whitespaces=True), _changed(rule="nfkc", remove_extra_whitespaces=True)):
        own, library = S.Model(raw), spm.SentencePieceProcessor(model_proto=raw)
        for text in long:
            ids = library.encode(text)
            said = library.decode(ids)
            assert own.digests(text.encode())[:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert len(list(own.windows(long[4].encode()))) > 20


@pytest.mark.parametrize(("short", "memo", "together"), [(0, 400_000, 50), (10**9, 40, 50), (64, 0, 10**9)])
def test_parts_are_joined_alike(monkeypatch, short, memo, together):
    """One by one, all at once, and with a memo that is always full."""
    for k, v in (("SHORT", short), ("MEMO", memo), ("TOGETHER", together)):
        monkeypatch.setattr(S, k, v)
    own, library = S.Model(_changed()), spm.SentencePieceProcessor(model_file=PATH)
    for seed in range(4):
        texts = [*_texts(150, seed), "".join(random.Random(seed).choice("abno ") for _ in range(900))]
        ids, _, _, count = own.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == library.encode(texts)


def test_operator(spark, docs, texts, empty, monkeypatch):
    importable(spark)
    library = spm.SentencePieceProcessor(model_file=PATH)
    rows = docs.unionByName(docs.filter("doc_id < 4"))
    got = S.digests(rows, PATH).collect()
    assert len(got) == len(texts) + 4
    for g in got:
        text = texts[g["doc_id"]] or ""
        ids = library.encode(text)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(text.encode())
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"], g["covered_bytes"]) == want
    pieces = S.encode(rows, PATH)
    for p in pieces.collect():
        raw = (texts[p["doc_id"]] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(p["begins"], p["ends"])) == raw  # the spans cover the text
    assert {(r["doc_id"], r["text"]) for r in S.decode(pieces, PATH).collect()} == {(i, t or "") for i, t in enumerate(texts)}
    assert S.digests(empty, PATH).collect() == S.encode(empty, PATH).collect() == []
