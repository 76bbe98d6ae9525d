from __future__ import annotations

import random
import re

from siltstone.llm import quality

SCHEMA = "doc_id long, text string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice(["a ", "b ", "é# ", "\n", "x|y ", "\x0b", "a b a b\n"]) for _ in range(r.randrange(60))), 0) for i in range(200)]
    rows += [(900, None, 0), (901, "", 0), (902, " \n \n", 0), (903, "𝄞 < >", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: tuple(x[k] for k in quality.COUNTS) for x in quality.statistics(docs).collect()}
    assert got == {d: brute(t) for d, t, _ in rows}
    kept = quality.apply_rules(quality.statistics(docs), [])
    assert kept.where("kept = base_failed").count() == 0


def test_rows_that_the_base_rules_reject_teach_nothing(spark):
    fine = lambda i: " ".join(f"w{i}_{k}" for k in range(20 + i % 9))
    rows = [(i, fine(i) + (" # $ % &" if i % 4 == 0 else "") if i % 4 != 1 else "! ! ! " * 20) for i in range(200)] + [(0, fine(0)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(200)], "doc_id long, quality int")
    both, own = quality.fit(docs, labels), quality.fit(docs, labels, base_too=False)
    assert [c[0] for r in own for c in r.conditions] == ["symbols_per_word"] and len(both) >= 2
    judged = quality.apply_rules(quality.statistics(docs), own).where("not base_failed and doc_id > 0")
    assert judged.where("kept = (doc_id % 4 = 0)").count() == 0


def test_long_texts(spark):
    text = " ".join(f"w{i % 5000}" for i in range(40_000)) + "\n" + "# " * 3000 + "\n\n" + "same line\n" * 500
    docs = spark.createDataFrame([(1, text, 0), (2, "x" * 300_000, 0), (3, "\n" * 100_000, 0)], SCHEMA)
    got = {x.doc_id: x for x in quality.statistics(docs, carry=("text",)).collect()}
    assert (got[1].n_words, got[1].n_symbols, got[1].n_dup_lines) == (44_000, 3000, 499) and got[1].text == text
    assert got[1].n_repeat_words == 44_000 and got[2].n_words == 1 and got[2].word_chars == 300_000 and got[3].n_words == 0
