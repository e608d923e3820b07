"""The whole rule of the main text, from page trees whose text is known without the scanner."""

import random

import pytest

from sparkwave.llm.html_text import extract, page_lines

MAIN = "<p>One.</p><p>Two.</p>"


@pytest.mark.parametrize("page", [
    f'<body class="single no-sidebar"><article>{MAIN}</article></body>',
    f'<html class="no-ad"><body><article>{MAIN}</article></body></html>',
    f'<div id="main" class="content has-sidebar"><article>{MAIN}</article></div>',
    f'<article class="post comments-open">{MAIN}</article>',
    f'<main class="search-results">{MAIN}</main>',
    f'<form action="/"><input name="q"><article>{MAIN}</article></form>',
    f'<div class="page banner"><div class="login"><div role="main">{MAIN}</div></div></div>',
    f'<form><fieldset><main>{MAIN}</main></fieldset></form><div class="related"><article>More</article></div>',
    f'<aside><article>Teaser</article></aside><form class="modal"><article>{MAIN}</article></form>',
    f'<div class="related"><article>Teaser</article></div><article>{MAIN}</article>',
    f'<article class="comments-open">{MAIN}<section class="comments-list">No</section><div class="cookie-notice">No</div></article>',
])
def test_everyday_templates_keep_their_article(page):
    assert [t for t, z in page_lines(page) if z == "main"] == ["One.", "Two."]


def test_words_that_name_parts_still_drop_them():
    for name in ("sidebar", "ad-slot", "site-footer", "cookie_banner", "social-share", "comments", "Main-Nav", "x ad"):
        assert page_lines(f'<div class="{name}">a</div><p>b')[0][1] == "drop"
    for name in ("no-sidebar", "with-comments", "search-results", "sidebar-layout", "adverse", "comments-closed"):
        assert page_lines(f'<div class="{name}">a</div><p>b')[0][1] == ""


class Tree:
    """Random pages: html, and the lines with their zones by a rule of its own over the tree."""

    HARD, FORM = ["nav", "aside", "footer", "menu"], ["form", "fieldset"]
    SOFT = ["ad", "sidebar", "comments", "promo box", "share-links"]
    PLAIN = ["", "", "", "content", "no-sidebar", "post comments-open", "lead"]

    def __init__(self, rng):
        self.rng, self.n = rng, 0
        self.root = self.node("body", rng.choice(self.PLAIN + self.SOFT), 0)

    def node(self, tag, name, depth):
        rng, children = self.rng, []
        for _ in range(rng.randint(1, 4)):
            if depth > 3 or rng.random() < 0.45:
                self.n += 1
                children.append(f"Line {self.n}.")
            else:
                tag_ = rng.choice(["div", "section", "div", "article", "main", rng.choice(self.HARD), rng.choice(self.FORM)])
                children.append(self.node(tag_, rng.choice(self.PLAIN * 2 + self.SOFT), depth + 1))
        return tag, name, children

    def html(self, node=None):
        tag, name, children = node or self.root
        inner = "".join(f"<p>{c}</p>" if isinstance(c, str) else self.html(c) for c in children)
        return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{inner}</{tag}>"

    def paths(self):
        """(line, path of nodes to it), in page order."""
        def walk(node, path):
            for c in node[2]:
                if isinstance(c, str):
                    yield c, [*path, node]
                else:
                    yield from walk(c, [*path, node])

        return list(walk(self.root, []))

    def articles(self):
        def walk(node, path):
            if node[0] in ("article", "main"):
                yield [*path, node]
            for c in node[2]:
                if not isinstance(c, str):
                    yield from walk(c, [*path, node])

        return list(walk(self.root, []))

    def hard(self, path):
        return any(n[0] in self.HARD for n in path)

    def soft(self, node):
        return node[0] in self.FORM or (node[1] in self.SOFT and node[0] not in ("body", "article", "main"))

    def lines(self):
        dropped = lambda path, spared=(): self.hard(path) or any(self.soft(n) and not any(n is s for s in spared) for n in path)
        articles = self.articles()
        spared = ()
        if articles and all(dropped(p) for p in articles):
            spared = next((p[:-1] for p in articles if not self.hard(p)), ())
        in_article = lambda path: any(n[0] in ("article", "main") for n in path)
        return [(t, "drop" if dropped(p, spared) else "main" if in_article(p) else "") for t, p in self.paths()]


def test_zones_of_random_pages():
    rng = random.Random(12)
    seen = set()
    for _ in range(3000):
        tree = Tree(rng)
        want = tree.lines()
        assert page_lines(tree.html()) == want, tree.html()
        seen |= {z for _, z in want}
    assert seen == {"main", "drop", ""}


def lcs(a, b):
    """Positions of a in a longest common subsequence, by the plain table (lines of one page are all different here)."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif size[i][j - 1] == size[i][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_differencing_alone_decides_on_templates_without_names(spark):
    """Pages of four hosts whose templates have neither articles nor known names: only shared lines tell the text from the rest."""
    rng, rows, want = random.Random(3), [], {}
    for host in range(4):
        head = [f"Host {host}", *(f"Topic {host}.{k}" for k in range(5))]
        foot = [f"Imprint {host}", f"All rights {host}"]
        for page in range(30):
            own = [f"Text {host} {page} {k}" for k in range(rng.randint(1, 6))]
            blocks = "".join(f"<div class='c{k % 7}'>{t}</div>" for k, t in enumerate([*head, *own, *foot]))
            rows.append((host * 100 + page, f"http://h{host}.example/a/{page:02}", blocks))
            want[host * 100 + page] = (own, head + own + foot)
    for page_id, (own, lines) in want.items():  # every neighbour shares the template and nothing else
        other = next(v[1] for k, v in want.items() if k != page_id and k // 100 == page_id // 100)
        assert [lines[k] for k in range(len(lines)) if k not in lcs(lines, other)] == own
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in out} == {k: "\n".join(own) for k, (own, _) in want.items()}
    assert all(r["n_differenced"] == 8 for r in out)
