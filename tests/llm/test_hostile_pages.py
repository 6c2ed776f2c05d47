"""Pages that open what they never close take linear time; small ones are cut where one would expect."""

import time

import pytest

from pagespan.llm import warc


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<script>", "<title>", "<html ", "<p ", '<a href="', "<style ", "<template><script>", "<!-- --", "<a href=", "</p "])
def test_two_megabytes_of_openings(piece):
    took = []
    for size in (250_000, 2_000_000):
        page = (piece * (size // len(piece))).encode()
        began = time.process_time()
        assert len(warc.derive({}, page)) == 2
        took.append(time.process_time() - began)
    assert took[1] < 5 and took[1] < 30 * max(took[0], 0.05), took


def test_pieces_of_pages():
    page = "<!-- a <p> --><html><html lang='ko-KR'><TITLE >x &lt; y</title ><script>a<b</script\n>one<p>two<br/>three<style>never closed <b>bold</b> 1 < 2 <a id=1>n</a><a href=\"q>r\">s</a><a href=t>u</a>< p>"
    assert warc.title_of(page) == "x &lt; y" and warc.language_of(page) == "ko-KR"
    assert list(warc.links(warc.without_code(page))) == ["q>r", "t"]
    assert warc.plain_text(page) == 'x < y\none\ntwo\nthreenever closed bold 1 < 2 nr">su< p>'
    assert warc.without_code("<script>x</SCRIPT>y<script>z") == " y<script>z"
    assert warc.without_code("a<!-->b-->c<!--d") == "a c<!--d"
