import random
import re

from lodestone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}

    def passes(line):
        n = len(WORD.findall(line))
        if not n:
            return True
        if line.rstrip(quality.SPACE)[-1] not in quality.CLOSING:
            return False
        bars = len(re.findall(quality.SEPARATORS, line))
        if bars >= 2 and bars * 4 >= n or len(re.findall(quality.SYMBOLS, line)) * 10 > n:
            return False
        return n > quality.PHRASE_LINE_WORDS or not any(p in line.lower() for p in quality.PHRASES)

    cleaned = "\n".join(x for x in lines if passes(x))
    lost = len(text) - len(cleaned)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(quality.SYMBOLS, text)), dup, len(covered), cleaned, lost, failed, not failed and 100 * lost <= 50 * len(text))


def test_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["a", "b", "the", "of.", "  ", "\n", "é", "|", "#", "\t", "end.\n", "All rights reserved.\n", " nav | bar | home\n", "\x0b", "日本。\n", "!!", "\n\n"]
    texts = [None, "", " \n\t", "one", "a a a a a a", "x y z x y z", "same line.\nsame line.\n same line.", "w " * 3000]
    texts += [" ".join(rng.choices(parts, k=rng.randint(1, 200))) for _ in range(150)]
    texts += [". ".join(f"word{rng.randint(0, 400)}" for _ in range(120)) + "." for _ in range(10)]
    # one long line that mentions a phrase, and scripts with closing marks of their own, stay
    texts += [" ".join(["word%d" % i for i in range(60)]) + " privacy policy.", "\n".join(f"यह वाक्य {i} है और {i * 7} भी।" for i in range(20)), "\n".join(f"کیا {i} اور {i * 7} ہے؟ جی {i} ہاں۔" for i in range(20))]
    stay = range(len(texts) - 3, len(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    out = {r.doc_id: r for r in quality.measured(docs).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.cleaned, r.lost_chars, r.base_failed, r.kept) == brute(t), t
    assert all(out[i].kept and not out[i].lost_chars for i in stay)
    assert quality.measured(docs.limit(0)).collect() == []


def test_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
