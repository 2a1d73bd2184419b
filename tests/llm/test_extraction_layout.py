"""Names of classes that mention furniture on the layout of a page."""

from __future__ import annotations

import pytest

from mercato.llm.extraction import main_text


@pytest.mark.parametrize("page", [
    "<html><body class='has-sidebar'><div><p>{}</p></div><div class=sidebar>side</div></body></html>",
    "<html><body><main class='no-comments'><p>{}</p></main></body></html>",
    "<html><body><div id='page' class='with-header'><p>{}</p><div class=ad>buy</div></div></body></html>",
    "<html><body><div data-id='menu'><p>{}</p></div><nav>menu</nav></body></html>"])
def test_layout_is_never_furniture(page):
    words = "the text of the article in many words"
    html = page.format(words)
    assert main_text(html) == words
