"""Line-block distribution against a plain version, and pages whose marks mislead."""

import random

from relweave.llm import pages

PARAGRAPH = "<p>" + "some text of the body of a page " * 7 + "</p>"
LINE = " ".join(("some text of the body of a page " * 7).split())


def brute(weight, home, heading):
    """The rule read literally, window by window, for lines outside of marked elements or in one."""
    n = len(weight)
    lift = [w * (pages.HOME_WEIGHT if h else 1) for w, h in zip(weight, home)]
    total = {i: sum(lift[k] for k in range(i, min(n, i + pages.WINDOW))) for i in range(n)}
    if not n or max(total.values()) == 0:
        return []
    top = max(total.values())
    lead = {i: min((k for k in range(i, min(n, i + pages.WINDOW))), key=lambda k: (-lift[k], k)) for i in total}
    hot = [i for i in total if total[i] >= top * pages.SURGE_SHARE and total[i] >= min(top, pages.SURGE_CHARS)]
    first = min(i for i in total if total[i] == top)
    if home[lead[first]]:
        return [k for k in range(n) if home[k] and any(home[lead[i]] == home[k] for i in hot)]
    hot = [i for i in hot if not home[lead[i]]]
    empty = {i for i in range(n) if not any(weight[k] for k in range(i, min(n, i + pages.WINDOW)) if not home[k])}
    start = max([i + 1 for i in empty if i < hot[0]], default=0)
    stop = min([i for i in empty if i > hot[-1]], default=n)
    kept = [k for k in range(start, stop) if not home[k]]
    front = next((i for i, k in enumerate(kept) if weight[k] or heading[k]), len(kept))
    back = max((i for i, k in enumerate(kept) if weight[k]), default=-1)
    return kept[front:back + 1]


def test_distribution_equals_its_definition():
    rng = random.Random(8)
    for _ in range(3000):
        n = rng.randrange(0, 16)
        weight = [rng.choice([0, 0, 5, 40, 90, 400]) for _ in range(n)]
        home, now = [], 0
        for _ in range(n):
            now = rng.choice([now, now, now, 0, 1, 2])
            home.append(now)
        heading = [rng.random() < 0.2 for _ in range(n)]
        assert pages.distribution(weight, home, heading) == brute(weight, home, heading), (weight, home, heading)


def test_a_teaser_does_not_stand_for_the_body():
    teaser = "<article><p>Short teaser card text here.</p></article>"
    assert pages.main_text(f"<body><div>{PARAGRAPH * 4}</div>{teaser}</body>") == "\n".join([LINE] * 4)
    assert pages.main_text(f"<body><div>{PARAGRAPH * 2}{teaser}{PARAGRAPH * 2}</div></body>") == "\n".join([LINE] * 4)


def test_a_list_of_links_inside_the_text_stays():
    items = "".join(f"<li><a href='#'>reference number {i}</a></li>" for i in range(6))
    wanted = "\n".join([LINE] * 3 + [f"reference number {i}" for i in range(6)] + [LINE] * 2)
    for place in ("article", "div"):
        assert pages.main_text(f"<{place}>{PARAGRAPH * 3}<ul>{items}</ul>{PARAGRAPH * 2}</{place}>") == wanted


def test_ids_made_from_headings_stay():
    body = f"{PARAGRAPH}<h2 id='related-work'>Related work</h2><p>Body a.</p><section id='search'><h2 id='search'>Search</h2><p>Body b.</p></section>"
    tail = "<div class='related-posts'><p>Read this too.</p></div><div class='share'>Share it</div>"
    assert pages.main_text(f"<article>{body}{tail}</article>") == f"{LINE}\nRelated work\nBody a.\nSearch\nBody b."
    assert pages.main_text("<div id='related-work'>" + PARAGRAPH + "</div>") == LINE


def test_pages_without_text():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>Home</nav>") == ""
    assert pages.main_text("<p>a</p>") == "a" and pages.distribution([], [], []) == []
