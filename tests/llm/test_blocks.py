import pytest

from litweave.llm import markup
from litweave.llm.markup import clean

PROSE = "We study how novices learn to weld in a virtual workshop, and what they take with them when they go back to the real one after the study has ended. " * 2
MENU = "Home | About | Publications | Software | Teaching | Contact | Newsletter | Impressum"
LISTED = "Proceedings Volumes Archive Editorial Board Author Guidelines Submission Portal Open Access Policy"
FOOTER = "© 2024 ACME Digital Publishing House, Terms, Privacy, Cookies, Accessibility. All rights reserved."


@pytest.mark.parametrize("junk", [MENU, LISTED, FOOTER, "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>", "[Home](/) [News](/n) [About us](/a)"])
def test_boilerplate_between_prose_is_dropped(junk):
    assert clean(f"{PROSE}\n\n{junk}\n\n{PROSE}")[0] == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def test_short_blocks_inherit():
    text, blocks, _ = clean(f"<h2>Links</h2><ul><li><a href='/'>Home</a></li></ul>\n\n{LISTED}\n\nFollow us\n\n{FOOTER}\n\n{PROSE}\n\nThanks\n\n{PROSE}")
    assert [b[3] for b in blocks] == ["bad", "bad", "bad", "bad", "bad", "good", "good", "good"]
    assert text == f"{PROSE.strip()}\n\nThanks\n\n{PROSE.strip()}"


def test_density_decides(monkeypatch):
    page = f"{PROSE}\n\n{LISTED}\n\n{PROSE}"
    with_rule = clean(page)[0]
    monkeypatch.setattr(markup, "STOP_LOW", 0.0)
    assert LISTED not in with_rule and LISTED in clean(page)[0]


@pytest.mark.parametrize(
    "text",
    [
        f"{PROSE}\n\nKeywords: virtual reality, welding, training, haptics, head-mounted displays, novices",
        f"# Steps\n\n- weld the seam with the torch of the simulator, slag hammer, wire brush, gauge, clamp\n- cool\n\n{PROSE}",
        f"{PROSE}\n\n```\nx = 1\n```\n\n$$E = mc^2$$",
        f"{PROSE}\n\n虚拟现实环境中的焊接训练研究：新手如何学习以及他们在研究结束后带回真实车间的内容，我们对此进行了为期三周的观察和分析并报告结果以及今后工作的方向和限制，敬请参阅全文",
        f"{LISTED}\n\nHome",
    ],
)
def test_a_field_keeps_its_structure(text):
    assert all(b[3] == "good" for b in clean(text)[1])


@pytest.mark.parametrize("text", ["Compare 5 <b and b> 3", "snake __init__ method", "if a < b and c > d", "<5 minutes and >3 users", "price $5 and $6", "x_1 and y_2 in file_name.txt", "", "   ", "3. Clause of a contract"])
def test_prose_is_left_alone(text):
    got = clean(text)
    assert got[0] == text.strip() and not got[2]


@pytest.mark.parametrize("text, want", [("a <b>bold</b> word", "a bold word"), ("<td nowrap>x</td>", "x"), ("<input disabled> y", "y"), ("an <i class=x>italic</i>", "an italic"), ("__strong__ words", "strong words"), ("__a b__ c", "a b c")])
def test_syntax_is_found(text, want):
    got = clean(text)
    assert got[0] == want and got[2]
