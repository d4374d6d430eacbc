"""Added tokens of the tokenizer file in texts."""

from loomgraph.llm import packing


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, end * 2, f"one two{end}three", f"one {end} two\n{end}\n", f" {end}  x\t{end}", "<|endoftext", f"<|{end}|>", "no token", f"{end} word " * 400]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in sorted(packing.pack_documents(docs, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got[r["doc_id"]]) and r["length"] == len(r["ids"])
        got[r["doc_id"]] += r["ids"]
    assert list(got.values()) == want and 50256 in want[0]
