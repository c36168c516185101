import public_tokenizers as P

from cohortlens.llm import byte_bpe

MULTI = P.path("byte_bpe_multi_50k.tiktoken")

def test_new_words_of_several_groups_are_merged_at_once(monkeypatch):
    texts = [f"zq{i}xv qzz{i % 7}wk Ünï{i}" * 3 for i in range(60)] + ["", " \n"]
    alone = byte_bpe.Encoder(MULTI, P.PATTERN)
    want = [alone.encode_all([x])[0] for x in texts]
    enc, calls = byte_bpe.Encoder(MULTI, P.PATTERN), []
    merge = enc.merge
    monkeypatch.setattr(enc, "merge", lambda pieces: calls.append(len(pieces)) or merge(pieces))
    assert enc.encode_all(texts, chars=100) == want
    assert len(calls) == 1
    assert [byte_bpe.decoder(MULTI).decode(x).decode() for x in want] == texts
