"""Token ids against a tokenizer that nothing here has touched."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.helpers import documents, odd_texts
from weftgraph.llm import best_fit_packing
from weftgraph.llm.queries import WORD_VOCABULARY

MARKED = ["stop <|endoftext|> go", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|>", "é<|endoftext|>ß 日本<|startoftext|>語", "<|endoftext |> < |endoftext|>", "x\n<|endoftext|>\ty"]


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys_with_its_special_tokens():
    fresh, rng = Tokenizer.from_file(WORD_VOCABULARY), random.Random(2)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "Stop", "it's", "12", "é", "ﬁ", "́", " ", "\n", "!?", "日本"]
    texts = MARKED + [t or "" for t in odd_texts()] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    ids, bounds = best_fit_packing.WordIds(WORD_VOCABULARY)(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == _ids(fresh, text), text


def test_packed_pieces_hold_the_librarys_ids(spark):
    fresh, texts = Tokenizer.from_file(WORD_VOCABULARY), MARKED + odd_texts()
    rows = best_fit_packing.pack_documents(spark, documents(spark, texts, extra=True), WORD_VOCABULARY).collect()
    for k, text in enumerate(texts):
        ids = [*_ids(fresh, text), 0]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        cuts = [(i, i * 2048, ids[i * 2048 : (i + 1) * 2048]) for i in range(-(-len(ids) // 2048))]
        assert got == [(i, at, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, at, c in cuts]
