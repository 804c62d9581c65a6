"""What the exchanges and sorts of a plan carry."""


def moved(df) -> set[str]:
    """Names of all columns that an exchange or a sort of the plan holds."""
    out = set()

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "Exchange" in p.nodeName() or p.nodeName() == "Sort":
            out.update(a.name() for a in items(p.output()))
        for x in items(p.children()):
            walk(x)

    walk(df._jdf.queryExecution().executedPlan())
    return out
