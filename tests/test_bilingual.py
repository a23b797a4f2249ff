"""Texts in two languages: known cases, and the scan for cuts against one that looks at each place anew."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillmill.functions.scripts import FILLER, cut_places, script_parts
from quillmill.operators.bilingual import align_runs, nearest_breaks, pair_cards

HAN, WORD = re.compile("[一-鿿]"), re.compile("[A-Za-z]+(?:['’][A-Za-z]+)*")


def first_cut(text: str) -> int:
    """The first place of a text where it is cut, or -1, looking at the whole text before and after each place."""
    letters = [i for i, c in enumerate(text) if HAN.match(c) or (c.isascii() and c.isalpha())]
    for a, b in zip(letters, letters[1:], strict=False):
        between, pre, post = text[a + 1 : b], text[:b], text[b:]
        if bool(HAN.match(text[a])) == bool(HAN.match(text[b])) or not re.fullmatch(f"[{FILLER}]*", between):
            continue
        bare = re.sub(f"^[{FILLER}]+", "", pre).strip()
        bare = re.sub(f"[{FILLER.replace(':：', '')}]+$", "", bare).strip()
        tail = re.sub(f"[{FILLER.replace(':：', '')}]+$", "", pre).strip()
        cue = re.search("[>→\\-–—]", between) or re.search("[：:。！？!?；;]$", tail)
        short = 0 < len(bare) <= 24 and not re.search("[。！？!?；;]", bare) and (re.search(r"\s", bare) or bare[-1] in ":：")
        n_han, n_word = len(HAN.findall(pre)), len(WORD.findall(pre))
        if HAN.match(text[a]):
            after = not HAN.search(post[:24]) and (len(WORD.findall(post[:80])) >= 3 or (len(WORD.findall(post[:40])) >= 2 and re.match(r"[A-Za-z][A-Za-z\s'’-]{1,40}[:：]", post[:40])))
            good = (n_han >= 6 and cue) or (short and 2 <= len(HAN.findall(bare)) <= 10 and not WORD.search(bare))
        else:
            after = len(HAN.findall(post[:40])) >= 6 and len(WORD.findall(post[:24])) <= 1
            good = (n_word >= 3 and cue and re.search(r"[A-Za-z0-9]\s+[A-Za-z]", tail)) or (short and len(WORD.findall(bare)) >= 2 and not HAN.search(bare))
        if after and good:
            lead = re.search("[>→\\-–—]", between)
            return a + 1 + lead.start() if lead else b
    return -1


def plain_cuts(text: str) -> list[int]:
    start = len(text) - len(text.lstrip())
    rest, places = text.strip(), []
    for _ in range(6):
        at = first_cut(rest)
        if at <= 0:
            break
        start += at
        places.append(start)
        rest = rest[at:]
    return places


def test_cuts_equal_the_plain_search():
    dice = random.Random(1)
    bits = ["长期记忆的研究背景", "说明文字", "所以", "完整解析", "one two three four", "Data Ingest", "it's", "tmux-cli", "2024", "：", ": ", " → ", "-", "。", " ", "  ", "，", "a", "中"]
    for _ in range(4000):
        text = "".join(dice.choice(bits) for _ in range(dice.randrange(1, 14)))
        assert cut_places(text) == plain_cuts(text), text


def test_known_cuts(spark):
    cases = {
        "Why it matters: 为什么大型语言模型的长期记忆问题仍未解决": 2,
        "Despite what you see, memory remains unsolved. 尽管表面如此，长期记忆问题仍未解决。": 1,
        "所以： Data ingest: all of it": 2,
        "tmux-cli-driver: 这是一个命令行工具的说明": 2,
        "tmux-cli-driver-of-a-long-name: 这是一个命令行工具的说明": 1,
        "只有中文": 1,
        "": 0,
        "   ": 0,
    }
    rows = spark.createDataFrame([*cases.items(), (None, 0)], "text string, n int")
    assert all(len(r["parts"] or []) == r["n"] for r in rows.select("n", script_parts(F.col("text")).alias("parts")).collect())


THREE = ["how it works", "A first paragraph that is somewhat longer than the others, with strategy and copy", "paper + code by some group"]
TRANSLATED = ["工作原理", "第一段比其他段落长一些，包含策略和复制", "论文和代码由某个团队编写"]


def aligned(spark, one, two, **how):
    rows = [("d", "original", i, t, h) for i, (t, h) in enumerate(one)] + [("d", "translation", i, t, h) for i, (t, h) in enumerate(two)]
    out = align_runs(spark.createDataFrame(rows, "doc string, side string, pos int, text string, html string"), **how).collect()
    return [[r["text"] for r in sorted(out, key=lambda r: r["pos"]) if r["side"] == side] for side in ("original", "translation")]


def test_runs_of_unequal_length(spark):
    same = lambda texts: [(t, t) for t in texts]
    assert aligned(spark, same(THREE), same(["\n\n".join(TRANSLATED)])) == [THREE, TRANSLATED]
    whole = " ".join(TRANSLATED)
    assert aligned(spark, same(THREE), same([whole]), by_weight=False) == [["\n\n".join(THREE)], [whole]]
    assert aligned(spark, same(THREE), [(whole, f"<a>{whole}</a>")]) == [["\n\n".join(THREE)], [whole]]
    cut = aligned(spark, same(["aa aa", "bbbb bbbb bbbb"]), same(["一二三四，五六七八九十一二三四五六"]))
    assert cut == [["aa aa", "bbbb bbbb bbbb"], ["一二三四，", "五六七八九十一二三四五六"]]
    assert aligned(spark, same(["a", "b"]), same(["x", "y", "z"])) == [["a\n\nb"], ["x\n\ny\n\nz"]]
    assert aligned(spark, same(["a", "b"]), []) == [["a", "b"], []]
    assert aligned(spark, same(["a", "b"]), same(["", " ", ""])) == [["a", "b"], ["", " ", ""]]


def test_rows_are_dealt_by_document_once(spark):
    rows = spark.createDataFrame([("d", "original", 0, "a", "a"), ("d", "translation", 0, "b", "b"), ("d", "translation", 1, "c", "c")], "doc string, side string, pos int, text string, html string")
    plan = align_runs(rows)._jdf.queryExecution().sparkPlan().toString() + align_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(doc" in plan
    assert not any("hashpartitioning(doc" in line and "side" in line for line in plan.splitlines())


def test_breaks():
    assert nearest_breaks("one. two. three.", [4, 4, 6]) == [5, 10]
    assert nearest_breaks("abcdefghij", [1, 1]) == [5]
    assert nearest_breaks("ab", [1, 1, 1, 1]) == [1, 1, 2]


def cards(spark, groups):
    rows = [("c", i, j, role, text, text) for i, group in enumerate(groups) for j, (role, text) in enumerate(group)]
    out = pair_cards(spark.createDataFrame(rows, "doc string, line int, seg int, role string, text string, html string")).collect()
    return [(r["role"], r["text"]) for r in sorted(out, key=lambda r: (r["unit"], r["pos"]))]


def test_cards(spark):
    row = lambda text, role="normal": [(role, text)]
    paired = [("original", "The Top Papers of the Week"), ("translation", "本周人工智能论文"), ("spacer", ""), ("original", "- Memento"), ("translation", "- 纪念品")]
    assert cards(spark, [row("The Top Papers of the Week"), row("本周人工智能论文"), row("- 纪念品"), row("- Memento")]) == paired
    # three that could pair: the first two do
    three = cards(spark, [row("Some words here"), row("这里有一些字"), row("More words there")])
    assert [r for r, _ in three] == ["original", "translation", "spacer", "normal"]
    given = [[("original", "Trusted access for defense"), ("translation", "提供可信访问")], row("example.com"), [("original", "It expands."), ("translation", "它扩展了。")]]
    assert [r for r, _ in cards(spark, given)] == ["original", "translation", "spacer", "original", "translation"]
    mixed = cards(spark, [row("Why long memory remains unsolved: 为什么长期记忆问题仍未解决"), row("另一行中文说明文字", None)])
    assert mixed == [("original", "Why long memory remains unsolved:"), ("translation", "为什么长期记忆问题仍未解决"), ("spacer", ""), ("normal", "另一行中文说明文字")]
    assert cards(spark, [row(""), row("https://example.com/x")]) == []
