import random

from folioforge.functions import markdown as M


def random_markdown(rng, n):
    kinds = [lambda: "# T" + str(rng.random()), lambda: "### deep", lambda: "| a | b |", lambda: "```", lambda: "", lambda: "Prose über " * rng.randint(1, 30)]
    return "".join(rng.choice(kinds)() + "\n" for _ in range(n))


def test_normalize_examples():
    assert M.normalize("\nred\t\r\n \r\n\r\ngreen  \n\n\n")[0] == "red\n\ngreen\n"
    assert M.normalize("\n \n")[0] == ""
    assert M.normalize("~~~\nkept  \n\n\nkept\n~~~  \n")[0] == "~~~\nkept  \n\n\nkept\n~~~\n"


def test_normalize_is_idempotent_and_moves_offsets():
    rng = random.Random(1)
    for _ in range(60):
        once, _ = M.normalize(random_markdown(rng, rng.randint(0, 60)))
        assert M.normalize(once)[0] == once
    text = "oats\n\n\n\n\nrye  \nbarley\n"
    body, moved = M.normalize(text, [text.index("barley"), text.index("rye")])
    assert [body[m:] for m in moved] == ["barley\n", "rye\nbarley\n"]


def test_chunks_cover_the_text_in_order():
    rng = random.Random(2)
    for _ in range(60):
        text, target = random_markdown(rng, rng.randint(0, 120)), rng.randint(16, 400)
        parts = M.merge_small(text, M.split(text, target), target)
        assert "".join(text[c.start : c.end] for c in parts) == text
        for p, c in zip(parts, M.overlap(text, parts, 20)[1:], strict=False):
            assert 0 <= c.overlap <= 80 and c.start - c.overlap >= p.start


def test_overlap_starts_at_a_line():
    text = "sow the oats in march\ncut the hay before rain\nrest\n"
    last = text.index("rest")
    parts = M.overlap(text, [M.Chunk(0, last, (), 12), M.Chunk(last, len(text), (), 2)], 8)
    assert text[last - parts[1].overlap :].startswith("cut the hay")


def test_heading_paths():
    text = "# Paper\n\n" + "intro words here. " * 40 + "\n\n## 2 Evaluating\n\n### 2.1 Setup\n\n" + "setup words here. " * 60 + "\n"
    paths = [c["headings"] for c in M.chunk(text, 128, 0)]
    assert ["Paper", "2 Evaluating", "2.1 Setup"] in paths


def test_titles_and_summaries():
    assert M.local_title(None, "text", "my_report.pdf") == "my report"
    assert M.local_title(None, "# Slide 1\n## **Real**\n", "x.md") == "Real"
    assert M.local_summary("# T\n\nshort\n\nThis is a sentence of good length. And here is one more of them.\n").startswith("Extractive summary: This is a sentence")
    assert M.local_summary("short") is None


def test_wrappers():
    page = "# Garden\n\nOats, `rye`.\n\n~~~sh\ndig\n~~~\n\nDone."
    for mark, info in (("```", "markdown"), ("```", "GFM"), ("~~~", "commonmark"), ("`````", "md"), ("```", "")):
        for before in ("", "My answer follows:\n", " \n\ufeff"):
            for after in ("\n" + mark, "\n" + mark + "\n \n", ""):
                assert M.strip_wrapper(f"{before}{mark}{info}\n{page}{after}") == page, (mark, info, before, after)
    for stays in (page, "```text\nx\n```", "```yaml\na: 1\n```", "```\ndig\n```\n\nThen rest.", "# Plan:\n```md\nx\n```", "Look:\n\n```md\nx\n```", "p" * 121 + ":\n```md\nx\n```"):
        assert M.strip_wrapper(f"  {stays}\n") == stays


def test_paragraphs():
    assert M.paragraphs("a long hy-\nphen\nnext\n\nnew") == "a long hyphen next\n\nnew\n\n"
