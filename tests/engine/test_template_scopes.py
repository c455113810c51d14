"""Sets, macros, choices, slices, ranges and methods of templates."""

import pytest

from seqprep import operators as o
from seqprep.operators import template as t

SCHEMA = "a string, n long, words array<string>, m map<string,string>, nums array<double>"
ROW = ("  Ab cd ", 3, ["x", "y", "z"], {"k": "v"}, [1.5])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW, (None, None, None, None, None)], SCHEMA)


#: templates, and what they give for the row and for a row of nulls
CASES = {
    "{% set b = a.strip() %}{{ b }}|{{ b | length }}": ("Ab cd|5", "|"),
    "{% if n > 2 %}{% set k = 'big' %}{% elif n > 1 %}{% set k = 'mid' %}{% endif %}[{{ k }}]": ("[big]", "[]"),
    "{% set k = 1 %}{% for w in words %}{% set k = w %}{{ k }}{% endfor %}{{ k }}": ("xyz1", "1"),
    "{% if n == 3 %}{% set k = 1 %}{% else %}{% set k = 2.5 %}{% endif %}{{ k }}": ("1.0", "2.5"),
    "{{ 'yes' if n > 2 else 'no' }}{{ '!' if n > 5 }}": ("yes", "no"),
    "{{ words[1:] | join('-') }} {{ words[-2:-1] | join }} {{ a[2:4] }}": ("y-z y Ab", ""),
    "{% for i in range(1, 7, 2) %}{{ i }}{{ words[i] }},{% endfor %}": ("1y,3,5,", "1,3,5,"),
    "{% for i in range(words | length) %}{{ words[i] }}{% endfor %}": ("xyz", ""),
    "{% macro f(x, y='q') %}({{ x }}{{ y }}){% endmacro %}{{ f(n) }}{{ f(words[0], y=a.upper().strip()) }}": ("(3q)(xAB CD)", "(q)()"),
    "{% macro f(x) %}<{{ x }}>{% endmacro %}{% macro g(x) %}{{ f(x) }}{{ f(x) }}{% endmacro %}{{ g('i') }}": ("<i><i>", "<i><i>"),
    "{{ ['p', 'q'] | join('+') }} {{ n in [1, 3] }} {{ m['k'] }}{{ m[words[0]] }}": ("p+q True v", "p+q False"),
    "{{ a.split() | length }} {{ a.split('b')[0].strip() }} {{ '.'.join(words) }}": ("2 A x.y.z", ""),
    "{{ a + '!' if n == 3 else 'none' }} {{ words[0].startswith('x') }}": ("Ab cd ! True", "none"),
}


@pytest.mark.parametrize("template", CASES)
def test_values(df, template):
    found = {r.n: r.source for r in o.Jinja(template).map(df).select("n", "source").collect()}
    want = CASES[template]
    assert found[3] == want[0].strip()
    assert (found[None] or "") == want[1].strip()


@pytest.mark.parametrize("bad", ["{% set x %}", "{{ f(1) }}", "{% macro f(x) %}{{ f(x) }}{% endmacro %}{{ f(1) }}", "{{ [] }}", "{{ ['a', 1] }}", "{{ a[::2] }}", "{{ a.title() }}", "{{ n * 2 }}", "{{ (n + 1) | upper }}", "{{ words[a] }}", "{% macro f(x) %}{% endmacro %}{{ f }}", "{% macro f(x) %}{% endmacro %}{{ f(1, 2) }}", "{% macro f(x) %}"])
def test_errors(df, bad):
    with pytest.raises(t.TemplateError):
        o.Jinja(bad).map(df)


def test_fields_that_a_template_needs():
    made = t.variables(t.parse("{% set x = a | default(b) %}{% macro f(p, q=c) %}{{ p }}{{ d }}{% endmacro %}{% for i in range(e | length) %}{{ f(i, x) }}{{ g.h }}{% endfor %}{{ x }}"))
    assert made == {"a", "b", "c", "d", "e", "g"}
