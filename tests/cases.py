"""Random cases with answers by brute force: partitions, pair joins and workloads."""

import random


def partition_case(seed, rows=500, bits=3, bits2=2):
    """Values, and each value's row ids in the order a two-pass radix partitioning leaves them."""
    rng = random.Random(seed)
    values = [(i, rng.choice((rng.randrange(40), rng.randrange(2**31), 7))) for i in range(rows)]
    key = lambda v: (v % 2**bits, (v >> bits) % 2**bits2)
    return values, sorted((*key(v), i, v) for i, v in values)


def answer(tables, line):
    """The sums of a query line over tables of tuples, by nested loops; None where no row qualifies."""
    relations, predicates, projections = (part.split() if k != 1 else [p for p in part.split("&") if p] for k, part in enumerate(line.split("|")))
    cell = lambda row, ref: row[int(ref.split(".")[0])][int(ref.split(".")[1])]

    def holds(row, predicate):
        for op in "<>=":
            if op in predicate:
                left, right = predicate.split(op)
                if int(left.split(".")[0]) >= len(row) or "." in right and int(right.split(".")[0]) >= len(row):
                    return True  # told later
                a, b = cell(row, left), cell(row, right) if "." in right else int(right)
                return {"<": a < b, ">": a > b, "=": a == b}[op]

    rows = [()]
    for r in relations:
        rows = [(*row, new) for row in rows for new in tables[int(r)] if all(holds((*row, new), p) for p in predicates)]
    return [sum(cell(row, p) for row in rows) if rows else None for p in projections]


def workload(seed, tables, queries):
    """Query lines in batches over tables of equal key ranges, and the result file's lines."""
    rng = random.Random(seed)
    lines, want = [], []
    for k in range(queries):
        n = rng.randint(1, 3)
        relations = [rng.randrange(len(tables)) for _ in range(n)]
        width = [len(tables[r][0]) for r in relations]
        column = lambda a, width=width: f"{a}.{rng.randrange(width[a])}"
        predicates = [f"{column(a)}={column(a + 1)}" for a in range(n - 1)]
        predicates += [f"{column(rng.randrange(n))}{rng.choice('<>=')}{rng.randrange(12)}" for _ in range(rng.randint(0, 2))]
        rng.shuffle(predicates)
        line = f"{' '.join(map(str, relations))}|{'&'.join(predicates)}|{' '.join(column(rng.randrange(n)) for _ in range(rng.randint(1, 3)))}"
        lines.append(line)
        want.append(" ".join(str(s) if s else "NULL" for s in answer(tables, line)))
        if rng.random() < 0.3 or k == queries - 1:
            lines.append("F")
    return lines, want
