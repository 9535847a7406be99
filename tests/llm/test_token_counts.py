from tokenizers import Tokenizer

from tablewright.llm import token_counts
from tablewright.llm.bpe import DEFAULT_FILE


def brute(lengths):
    total = sum(lengths)
    return {
        n: (
            lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), total,
            sum(min(x, n) for x in lengths), sum(x <= n for x in lengths) / len(lengths),
        )
        for n in set(lengths)
    }


def test_histogram_of_documents(documents, odd_docs):
    library = Tokenizer.from_file(DEFAULT_FILE)
    for docs in (documents, odd_docs):
        lengths = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
        found = {r[0]: tuple(r[1:]) for r in token_counts.length_histogram(token_counts.encoded_lengths(docs)).collect()}
        assert found == brute(lengths)


def test_blocks_limits_and_quantiles(spark):
    lengths = [0, 0, 5, 4095, 4096, 4096, 20_000, 70_001, 5]
    histogram = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    assert {r[0]: tuple(r[1:]) for r in histogram.collect()} == brute(lengths)
    limits = [0, 1, 5, 4096, 10_000, 10**9]
    got = {r.context_limit: r.tokens for r in token_counts.truncated_totals(histogram, limits).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in limits}
    shares = {r.share: r.n_tokens for r in token_counts.length_quantiles(histogram, [0.1, 0.5, 1.0]).collect()}
    assert shares == {0.1: 0, 0.5: 4095, 1.0: 70_001}


def test_empty(spark, documents):
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(documents.limit(0)))
    assert histogram.count() == 0
    assert [r.tokens for r in token_counts.truncated_totals(histogram, [5]).collect()] == [0]
