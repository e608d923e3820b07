"""Token files with other tokenizer files: the word path is taken only where a file allows it."""

import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkwave.llm.token_files import WordEncoder, read_files, write_files

tokenizers = pytest.importorskip("public_tokenizers")
WORD = tokenizers.path("word_bpe_49k.json")


def changed(tmp_path, change):
    settings = json.load(open(WORD))
    change(settings)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    return str(path)


CHANGES = {
    "cased": lambda s: s["normalizer"]["normalizers"].pop(),
    "no normalizer": lambda s: s.update(normalizer=None),
    "digits in runs": lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"),
    "spaces kept": lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
    "plain added token": lambda s: s["added_tokens"].append({"id": 49408, "content": "the", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}),
}


@pytest.mark.parametrize("name", list(CHANGES))
def test_changed_files_encode_as_the_library(tmp_path, name):
    path = changed(tmp_path, CHANGES[name])
    encoder, whole, rng = WordEncoder(path), Tokenizer.from_file(path), random.Random(6)
    assert not encoder.by_words and WordEncoder(WORD).by_words
    for text in ["The Cat and the hat", "abc 1234 Éa", *("".join(rng.choice("aAbzZ éÉ,'129 \nthe") for _ in range(rng.randint(0, 60))) for _ in range(200))]:
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("file", ["cased", "byte_bpe_50k.json"])
def test_files_of_a_second_tokenizer(spark, tmp_path, file):
    path = changed(tmp_path, CHANGES["cased"]) if file == "cased" else tokenizers.path(file)
    rows = [(3, "The Cat"), (1, None), (2, "  x\n\n Y 12"), (5, "é" * 300), (4, "")]
    out = str(tmp_path / "ids")
    files = write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, out, partitions=2)
    whole, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in read_files(spark, files, out).collect()}
    for doc_id, text in sorted(rows):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_work_folders_are_removed_together(spark):
    import os

    from sparkwave.llm.common import fresh_dir, remove_work

    a, b = (fresh_dir(spark, name).removeprefix("file:") for name in ("one", "two"))
    assert os.path.dirname(a) == os.path.dirname(b) and a != b
    spark.range(3).write.parquet(a)
    remove_work(spark)
    assert not os.path.exists(os.path.dirname(a))


def test_a_kept_encoder_packs_the_same(spark):
    from sparkwave.llm.packing import pack

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma", "12", "é"], k=rng.randint(0, 50)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, two = (sorted(map(tuple, pack(df, WORD, max_len=16, keep_encoder=k).drop("ids").collect())) for k in (False, True))
    assert one == two and len(one) > 40
