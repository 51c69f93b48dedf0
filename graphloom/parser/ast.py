"""Syntax tree. Terms, paths, expressions and patterns are tagged tuples.

Terms        ('var', name) ('iri', text) ('lit', lexical, datatype, lang) ('bnode', label) ('param', name)
Paths        ('p', iri) ('inv', x) ('seq', a, b) ('alt', a, b) ('opt', x) ('plus', x) ('star', x)
             ('neg', ((iri, inverse), …))
Expressions  ('term', term) ('or' | 'and', a, b) ('not', a) ('cmp', op, a, b) ('in', a, list, negated)
             ('arith', op, a, b) ('minus', a) ('call', name, args) ('agg', name, distinct, expr, separator)
             ('exists', group, negated) ('scalar', Query)
Patterns     ('triples', list) ('filter', e) ('optional' | 'minus' | 'group', group) ('union', groups)
             ('graph', term, group) ('service', silent, term, group) ('bind', e, name)
             ('values', names, rows) ('select', Query)
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Query:
    form: str = "select"
    items: list = field(default_factory=list)
    star: bool = False
    distinct: bool = False
    where: list = field(default_factory=list)
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)
    limit: object = None
    offset: object = None
    values: tuple | None = None
    template: list = field(default_factory=list)
    resources: list = field(default_factory=list)
    from_default: list = field(default_factory=list)
    from_named: list = field(default_factory=list)
    allowed_graphs: list | None = None
    allowed_services: list | None = None


@dataclass
class Update:
    kind: str
    silent: bool = False
    replace: bool = False
    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    where: list | None = None
    with_graph: str | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    source: object = None
    target: object = None
    allowed_graphs: list | None = None
