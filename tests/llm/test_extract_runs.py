"""The maximum-scoring run: against a search of all runs, on fresh labelled pages, on pages labelled by hand, and on broken markup."""

import random
import time

import pytest
from hand_pages import PAGES


@pytest.fixture(scope="module")
def weights():
    from twinfold.llm.extract import learned_weights

    return learned_weights()


def all_runs(page, weights):
    """Score of the best run of any level, by trying every run of every part that is left after cuts made from the inside out."""
    scores, price = page.scores(weights), weights["cut"]
    best = 0.0

    def reduce(at):
        """Tokens of the element opened at a token, cuts applied: values and the token behind."""
        values, i = [scores[at]], at + 1
        while page.kind[i] != 2:
            if page.kind[i] == 1:
                more, i = reduce(i)
                values += more
            else:
                values.append(scores[i])
                i += 1
        values.append(scores[i])
        e = page.elements[page.own[i]]
        from twinfold.llm.extract import BLOCK

        unmarked = sum(weights.get(f, 0.0) for f in e.names()) >= weights.get(f"<{e.tag}>", 0.0)
        if e.words and sum(values) < price and not (e.tag not in BLOCK and unmarked):
            look(values)
            values = [price]
        return values, i + 1

    def look(values):
        nonlocal best
        for a in range(len(values)):
            for b in range(a + 1, len(values) + 1):
                best = max(best, sum(values[a:b]))

    values, i = [], 0
    while i < len(page.kind):
        if page.kind[i] == 1:
            more, i = reduce(i)
            values += more
        else:
            values.append(scores[i])
            i += 1
    look(values)
    return best


def test_best_run_equals_the_search_of_all_runs():
    from twinfold.llm.extract import Page, best_run

    rnd = random.Random(3)
    for _ in range(300):
        values = [rnd.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rnd.randrange(0, 14))]
        score, a, b = best_run(values)
        want = max([0.0, *(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))])
        assert score == want == sum(values[a:b])
    for _ in range(200):
        parts = []
        for _ in range(rnd.randrange(1, 14)):
            parts.append(rnd.choice(["<div>", "</div>", "<div class=x>", "<span class=x>", "</span>", "<p>", "one two three", "four", "<br>", "</p>", "<a href=u>five</a>"]))
        weights = {"word": 1.0, "link": -2.0, "block_tag": -rnd.random(), "inline_tag": -0.1, "link_tag": -0.2, "cut": -rnd.random() * 3, "x": -rnd.random() * 4, "most x": rnd.random() - 0.5, "<p>": rnd.random() - 0.5}
        page = Page("".join(parts))
        seen = []
        page.cut(page.scores(weights), weights["cut"], lambda e, t, page=page, w=weights: t >= w["cut"] or (page.elements[e].tag in ("span", "a") and sum(w.get(f, 0.0) for f in page.elements[e].names()) >= w.get(f"<{page.elements[e].tag}>", 0.0)), lambda left, value, seen=seen: seen.append(best_run(value)[0]))
        left, value = page.cut(page.scores(weights), weights["cut"], lambda e, t, page=page, w=weights: t >= w["cut"] or (page.elements[e].tag in ("span", "a") and sum(w.get(f, 0.0) for f in page.elements[e].names()) >= w.get(f"<{page.elements[e].tag}>", 0.0)))
        assert max([best_run(value)[0], *seen]) == pytest.approx(all_runs(page, weights))
        assert bool(page.best(weights)) == (all_runs(page, weights) > 0)


def test_fresh_labelled_pages_and_the_whole_page(weights):
    from twinfold.llm.extract import label, labelled_pages

    same = whole = 0
    pages = labelled_pages(200, seed=77)
    for pieces in pages:
        page, run = label(pieces)
        got = page.read(page.best(weights))
        same += got == page.read(run)
        whole += got == page.read(list(range(len(page.kind))))
    assert same >= 0.9 * len(pages) and whole <= 0.05 * len(pages)


@pytest.mark.parametrize("name", [name for name, _, _ in PAGES])
def test_pages_labelled_by_hand(weights, name):
    from twinfold.llm.extract import main_text

    source, want = next((h, t) for n, h, t in PAGES if n == name)
    assert main_text(source, weights) == want


def test_weights_decide_and_not_names(weights):
    """Without what was learned about names, marked parts stay."""
    from twinfold.llm.extract import main_text

    source = next(h for n, h, _ in PAGES if n == "advert in article")
    assert "shoes" not in main_text(source, weights)
    assert "shoes" in main_text(source, {k: v for k, v in weights.items() if k not in ("slot", "ad-")} | {"ad-": 0.0})


def test_broken_and_deep_markup_is_linear():
    from twinfold.llm.extract import main_text

    for source in ("<div>" * 20_000 + "some words here", "</div>" * 50_000 + "some words here", "<p class='ad'>" * 20_000 + "word " * 20_000, "<a " * 50_000, "<ul><li>" * 5_000 + "</ul>" * 5_000 + "some words here"):
        began = time.perf_counter()
        main_text(source)
        assert time.perf_counter() - began < 10
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- x -->") == ""
