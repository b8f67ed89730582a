import random
import re

from listingmill.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def corpus():
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b", "a a a", "a a a a", "x y z x y z", "é b c　d", "#*$%&|<> " * 20, "same\nsame\n same\n\nsame", "w " * 20_000]
    return texts + [rng.choice(" \n").join(rng.choices("abcde", k=rng.randint(0, 120))) for _ in range(40)]


def test_measurements(docs_of):
    texts = corpus()
    rows = {r.doc_id: r for r in rules.digest(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        want = brute(text) if i != 10 else (20_000, 20_000, 0, 0, 20_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_policies_and_ablations(docs_of):
    ledger = rules.ledger(docs_of(corpus())).cache()
    bits = [r.failed_bits for r in ledger.collect()]
    for policy in rules.POLICIES:
        assert sum(r.kept for r in rules.apply_policy(ledger, policy).collect()) == sum(b & policy.mask == 0 for b in bits)
        found = {r.rule: r for r in rules.ablations(ledger, policy).collect()}
        assert set(found) == set(policy.rules)
        for rule in rules.RULES:
            if rule.name in found:
                got = found[rule.name]
                assert got.n_failed == sum(b & rule.mask > 0 for b in bits)
                assert got.n_failed_alone == sum(b & policy.mask == rule.mask for b in bits)
                assert got.n_kept_without == sum(b & policy.mask & ~rule.mask == 0 for b in bits)
    assert len({r.bit for r in rules.RULES}) == len(rules.RULES)


def test_rows(docs_of):
    assert rules.digest(docs_of([(1, "a"), (1, "a"), (None, "b")])).count() == 3 and rules.digest(docs_of([])).count() == 0
