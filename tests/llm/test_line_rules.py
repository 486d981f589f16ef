import collections
import re

from rowloom.llm import line_rules
from tests.llm.common import documents, empty, frame, odd, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def check(docs, **limits):
    texts = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    minimum, share, loss = limits.get("min_docs", 10), limits.get("max_share", 0.1), limits.get("max_loss", 0.7)
    most = limits.get("max_docs", 10_000)

    def lines(t):
        low = re.sub("[0-9]", "0", (t or "").lower())
        return [tuple(WORD.findall(x)) for x in low.split("\n") if WORD.search(x)]

    held = collections.defaultdict(set)
    hosts, counts = collections.Counter(), collections.Counter()
    for _, t, s in texts:
        hosts[s or ""] += 1
        for x in set(lines(t)):
            held[s or "", x].add(t or "")
            counts[s or "", x] += 1

    def boilerplate(host, line):
        n = counts[host, line]
        return len(held[host, line]) > minimum and (n > share * hosts[host] or n > most)
    want = []
    for i, t, s in texts:
        m = measures(t)
        common = [x for x in lines(t) if boilerplate(s or "", x)]
        lost = sum(map(len, common))
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want.append((i, *m, lost, failed, not failed and lost <= loss * m[0]))
    got = line_rules.line_rules(docs, **limits)
    assert rows(got, *got.columns) == sorted(want, key=repr)


def test_agrees_with_brute_force(spark, data):
    check(documents(spark, data))
    check(documents(spark, data), min_docs=1, max_share=0.0, max_loss=0.3)
    check(documents(spark, data), min_docs=2, max_share=0.9, max_docs=3, max_loss=0.05)


def test_odd_rows(spark):
    check(odd(spark), min_docs=1, max_share=0.1)


def test_common_lines_of_a_host_deplete_a_document(spark):
    site = " ".join(f"site{chr(97 + j)}" for j in range(24))
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(12))
    texts = [f"{own(i)}\nShared LINE {i % 10} {site}" for i in range(12)] + [f"shared  line 7 {site}\nfew own words here"]
    got = line_rules.line_rules(frame(spark, texts + ["", None]), min_docs=3, max_loss=0.7)
    kept = dict(rows(got, "doc_id", "kept"))
    assert all(kept[i] for i in range(1, 13)) and not kept[13] and not kept[14] and not kept[15]


def test_banner_of_a_hot_host(spark):
    """A line in few of a huge host's documents is found by its count; documents that are little else go, copies of a text stay."""
    banner = " ".join(f"banner{chr(97 + j)}" for j in range(20))
    own = lambda i: " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(12))
    texts = [f"{banner}\n{own(i)}" if i % 20 == 0 else own(i) for i in range(600)]
    texts += [f"{banner} \njust {chr(97 + i)} words" for i in range(5)] + ["the same text over and over again in many places of one host"] * 40
    docs = frame(spark, texts)
    check(docs, max_docs=30)
    verdict = dict(rows(line_rules.line_rules(docs, max_docs=30), "doc_id", "kept"))
    assert [i for i, k in verdict.items() if not k] == [601, 602, 603, 604, 605]
    assert all(dict(rows(line_rules.line_rules(docs), "doc_id", "kept")).values())


def test_accepted_rows_keep_their_columns(spark):
    docs = odd(spark)
    out = line_rules.accepted(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    assert line_rules.accepted(empty(spark)).count() == 0
    verdict = line_rules.line_rules(docs)
    assert out.count() == verdict.filter("kept").count()


def test_accepted_texts_lose_the_common_lines_of_their_host(spark):
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(12))
    texts = [f"Menu {i}  HOME é\r\n\n{own(i)}\n  \nmenu {i} home É\nlast of {own(i)[::-1]}\nRead more" for i in range(8)]
    texts += [f"menu 9 home é\n{own(8)}", f"{own(9)}\n", f"Menu 1 away\n{own(10)}"]
    sources = ["a"] * 8 + ["b", "a", "a"]
    docs = frame(spark, texts, sources)
    normal = lambda x: tuple(WORD.findall(re.sub("[0-9]", "0", x.lower())))
    held = collections.Counter((s, x) for t, s in zip(texts, sources) for x in {normal(x) for x in t.split("\n")} if x)
    want = ["\n".join(x for x in t.split("\n") if held[s, normal(x)] <= 3) for t, s in zip(texts, sources)]
    out = line_rules.accepted(docs, min_docs=3)
    assert want[0] == f"\n{own(0)}\n  \nlast of {own(0)[::-1]}" and want[8:] == texts[8:]
    assert rows(out, "doc_id", "text", "n_chars") == sorted(((i, t, len(t)) for i, t in enumerate(want, 1)), key=repr)
