import random

import public_tokenizers
import sentencepiece

from rimeweave.llm.pieces import decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  ", " a", "a ", "a  b", "▁", "a▁ b", "a ▁▁b ", "<s> </s> <unk>", "x\ny\t z", "ﬁ ½ Ａ", "日本 語", "a\u00a0b",
    "\u0000 a", "😀 " * 3, "w" * 20_000, "the of " * 30_000, "e\u0301 é",
]


def test_against_the_library(spark, documents):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab  ▁é\n<s>日") for _ in range(rng.randrange(30))) for _ in range(500)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = HARD + made + HARD[:3]
    out = decode_pieces(encode_pieces(documents(*enumerate(texts)), MODEL), MODEL).collect()
    assert len(out) == len(texts)
    for row in out:
        want = model.encode(texts[row.doc_id] or "")
        assert row.ids == want and row.decoded == model.decode(want)
    both = encode_pieces(documents(*enumerate(texts)), MODEL, decode=True).select("doc_id", "ids", "decoded").collect()
    assert sorted(both) == sorted((r.doc_id, r.ids, r.decoded) for r in out)


def test_empty_table(documents):
    assert decode_pieces(encode_pieces(documents((1, "a")).limit(0), MODEL), MODEL).count() == 0
