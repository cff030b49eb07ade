"""Visible text of incomplete tables, drawings and formulas, and of very deep pages."""

import pytest

from portica.llm.html_render import render


def test_cells_and_text_without_a_row():
    assert render("<table><thead><th>A<th>B</thead><tbody><td>x</table>") == "A | B\nx"
    assert render("<table><td>a<td>b<tr><td>c</table>") == "a | b\nc"
    assert render("<table><thead>head<tr><th>A</thead><tbody>body<tr><td>x</tbody><tfoot>foot</table>") == "head\nbody\nfoot\nA\nx"
    assert render("<table><tbody hidden>no<td>no<tbody><td>yes</table>") == "yes"
    assert render("<table><colgroup><col><tbody><tr><td>x<td>y</table>") == "x | y"


def test_only_what_is_not_drawn_is_hidden():
    assert render("<p aria-hidden='true'>seen</p>") == "seen"
    assert render("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>") == "x=2"
    assert render("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>A</text><text>B</text></svg> after") == "A B after"
    assert render("<svg><defs/><text>A</text></svg><desc>word</desc>") == "A word"


@pytest.mark.parametrize("tag", ["<div>", "<span>", "<b>", "<font>", "<ul><li>", "<table><tr><td>", "<blockquote>"])
def test_depth_does_not_fail(tag):
    assert render(tag * 2000 + "deep").endswith("deep")
