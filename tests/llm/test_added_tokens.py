import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kurtosia.llm import packing


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y <|endoftext|", "plain  text\n"])
def test_documents_have_the_tokenizers_default_ids(spark, text):
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    row = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.ids_crc32 == zlib.crc32(np.array([*want, packing.END_ID], dtype="<u4").tobytes())
    assert row.doc_tokens == len(want) + 1
