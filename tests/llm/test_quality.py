from collections import Counter

from lithos.llm import quality


def brute(text):
    b = (text or "").encode()
    w = b.split()
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text or "")
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), chars, symbols, dup, len(hit)


def test_measures_and_verdicts(docs, texts):
    out = quality.cascade(docs, measures=quality.MEASURES)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in out.collect())
    want = [(*brute(t), not any(r.rejects(quality.Text((t or "").encode())) for r in quality.RULES)) for _, t in texts]
    assert got == sorted(want)


def test_order_never_changes_the_verdict(docs, texts):
    kept = sorted(x.text for x in quality.keep(docs).select("text").collect())
    for order in (quality.RULES, quality.RULES[::-1]):
        out = quality.cascade(docs, order=order)
        assert sum(r.kept for r in out.collect()) == len(kept)
    assert quality.keep(docs).columns == docs.columns


def test_order_is_rejection_per_cost():
    rules = tuple(quality.Rule(n, lambda t: False) for n in "abc")
    assert [r.name for r in quality.ordered(rules, [("a", 1.0, 0.1), ("b", 0.1, 0.2), ("c", 0.5, 0.5)])] == ["b", "c", "a"]


def test_estimates_and_empty(docs, no_docs):
    assert {n for n, _, _ in quality.estimate(docs)} == {r.name for r in quality.RULES}
    assert quality.cascade(no_docs).count() == 0 and quality.keep(no_docs).count() == 0
