"""Visible text in math, svg and map, and visibility that is overridden."""

from sediment.llm.html_text import extract


def test_math_and_map_are_text():
    assert extract("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b") == "a x=2 b"
    assert extract("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>") == "x"
    assert extract("<map name=m><p>see <a href=x>here</a><area href=y></map>") == "see here"


def test_svg_text_is_rendered():
    assert extract("a<svg><title>no</title><defs><text>no</text></defs><text>one</text><g><text>two <tspan>three</tspan></text></g></svg> b") == "a one two three b"
    assert extract("<svg><defs/><path d=x /><title/><style>no</style><a href=x><text>link</text></a></svg>z") == "link z"
    assert extract("<svg>no<desc>no</desc><foreignObject><p>html</foreignObject></svg>") == "html"
    assert extract("<svg><metadata>no</metadata><defs><p>out") == "out"


def test_visibility_is_inherited_and_overridden():
    assert extract("<div style='visibility:hidden'>no <b>no</b><p style='visibility: visible'>yes <i>too</i></p>no</div>z") == "yes too\n\nz"
    assert extract("<div style='display:none'>no<b style='visibility:visible'>no</b></div>z") == "z"
