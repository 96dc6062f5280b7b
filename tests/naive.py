"""A query evaluator by nested loops over a Python list of facts, to hold the compiler against."""

from factweave.plans.query import BLANK, Call, Not, Or, Pattern, Var

TESTS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _bind(row, terms, values):
    out = dict(row)
    for t, v in zip(terms, values):
        if t == BLANK:
            continue
        if isinstance(t, Var):
            if out.setdefault(t.name, v) != v:
                return None
        elif t != v:
            return None
    return out


def _rows(clause, rows, facts):
    if isinstance(clause, Pattern):
        return [b for r in rows for e, a, v in facts if a == clause.a and (b := _bind(r, (clause.e, clause.v), (e, v))) is not None]
    if isinstance(clause, Call):
        value = lambda r, x: r[x.name] if isinstance(x, Var) else x
        return [r for r in rows if TESTS[clause.fn](*[value(r, x) for x in clause.args])]
    if isinstance(clause, Not):
        own = clause.join
        return [r for r in rows if not solve(clause.clauses, [r if own is None else {v.name: r[v.name] for v in own}], facts)]
    assert isinstance(clause, Or)
    out = []
    for r in rows:
        for branch in clause.branches:
            start = r if clause.join is None else {v.name: r[v.name] for v in clause.join if v.name in r}
            for found in solve(branch, [start], facts):
                kept = found if clause.join is None else {v.name: found[v.name] for v in clause.join}
                if all(r.get(k, x) == x for k, x in kept.items()):
                    out.append({**r, **kept})
    return out


def solve(clauses, rows, facts):
    """Clauses in their written order; each must find its inputs bound."""
    for c in clauses:
        rows = _rows(c, rows, facts)
    return rows


def answers(q, facts):
    return {tuple(r[v.name] for v in q.find) for r in solve(q.where, [{}], facts)}
