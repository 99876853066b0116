import pytest

from quillstone.llm import chat
from quillstone.llm.html_density import Page, extract, main_text

LONG = "This paragraph has a good number of plain words, commas and all, and no links in it. "


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>a&amp;b&nbsp;&#233; &lt;x&gt;</p>", "a&b é <x>"),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        (f"<body><nav><a href=/>home</a></nav><article><h1>Top</h1><p>{LONG}<p>two  \n lines<br>here</article><footer>f</footer>", f"Top\n{LONG.strip()}\ntwo lines here"),
        (f"<body><div class='menu x'>m</div><div id=main><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>{LONG * 3}</p></div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div><h2>Head</h2><p>{LONG}</p><ul><li>first<li>second</ul></div></body>", f"Head\n{LONG.strip()}\nfirst\nsecond"),
        (f"<main><form>q</form><aside>s</aside><p>{LONG}<script>var a='<p>no</p>'</script><!-- no --></p><style>p{{}}</style></main>", LONG.strip()),
        (f"<article><p>{LONG}<b>bold<i>er</i> word</p></b></i></div></article>", f"{LONG}bolder word"),
        ("<article><p title='a>b'>kept</p><p>cut of", "kept\ncut of"),
        ("<article>x < y and <3 <> stay</article>", "x < y and <3 <> stay"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><div class='content no-sidebar'><p>{LONG}</p></div><div>x</div>", LONG.strip() + "\nx"),
        (f"<body><div class='post has-comments'><h2 id=related-work>Related</h2><p>{LONG}</p><h2 id=social>Social</h2><p>{LONG}</p></div>", f"Related\n{LONG.strip()}\nSocial\n{LONG.strip()}"),
        (f"<body><form class=widget><p>{LONG}</p><p>{LONG}</p></form>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><article><p class=ad>buy<p>{LONG}<ul><li class=share>tweet<li>{LONG}</ul></article>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><article><div class=ad><script>document.write('<div>a<\\/div>')</script>buy</div><p>{LONG}</p></article>", LONG.strip()),
    ],
)
def test_what_is_left_out_ends_where_it_ends(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article><div><a href=1>one</a><a href=2>two</a></div>", f"Title\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><main><h1>Title</h1><p>Lead. {LONG}</p><article>{f'<p>{LONG}</p>' * 6}</article></main>", f"Title\nLead. {LONG.strip()}" + f"\n{LONG.strip()}" * 6),
        (f"<body><div><article><p>One. {LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>Two. {LONG}</p><p>{LONG}</p></article></div>", f"One. {LONG.strip()}\n{LONG.strip()}\n{LONG.strip()}\nTwo. {LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_text_outside_the_core_article(html, text):
    assert main_text(html) == text


def test_density_falls_with_links():
    page = Page(f"<body><div><p>{LONG}</p></div><div><p><a href=x>{LONG}</a></p></div></body>")
    density, _ = page.densities()
    first, second = [i for i, n in enumerate(page.name) if n == "div"]
    assert density[first] > 2 * density[second] > 0


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long = "<article>" + f"<p>{LONG}</p>" * 3_000 + "</article>"
    deep = "<div>" * 3_000 + "x" + "</div>" * 3_000
    rows = [(1, "u", None, "t", 0), (2, None, "", "t", 0), (None, "u", long, "t", 0), (3, "u", deep, "t", 0), (3, "u", deep, "t", 0)]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in got) == sorted([("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("None", 3_000 * len(LONG) - 1, 3_000 * len(LONG) - 1)])
    assert extract(spark.createDataFrame([], schema)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, part int, segment string"


def plain_rotation(rows):
    out = {}
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in talks.items():
        import hashlib

        turns.sort(key=lambda u: (u[0], u[1], u[2], hashlib.md5(u[3].encode()).hexdigest()))
        for who in {u[2] for u in turns} - {"system"}:
            text, masks = "", []
            for _, _, r, x in turns:
                head = "<|im_start|>" + (r if r == "system" else "assistant" if r == who else f"user name={r}") + "\n"
                if r == who:
                    masks.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(x) + len('<|im_end|>')}")
                text += f"{head}{x}<|im_end|>\n"
            out[c, who] = (text, ",".join(masks))
    return out


def test_rotation(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi ü🎉"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 3, "cyd", "tie"), (1, 3, "cyd", "tie"),
        (2, 0, "system", "alone"), (3, None, None, "who <|im_end|> said"), (3, 1, "ann", "x" * 5_000), (None, 0, "ann", "lost"), (None, 1, "bob", ""),
    ]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(700)]
    frame = spark.createDataFrame([(*r, 9, "s") for r in rows], TURNS)
    want = plain_rotation(rows)
    whole = {(r.conv_id, r.perspective): (r.text, r.masks) for r in chat.rotate(frame).collect()}
    assert whole == want
    got = {}
    for r in sorted(chat.rotate(frame, part_chars=300).collect(), key=lambda r: (str(r.conv_id), r.perspective, r.part)):
        assert len(r.text) < 300 + 5_100
        text, masks = got.get((r.conv_id, r.perspective), ("", []))
        got[r.conv_id, r.perspective] = (text + r.text, masks + [m for m in r.masks.split(",") if m])
    assert {k: (t, ",".join(m)) for k, (t, m) in got.items()} == want
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0
