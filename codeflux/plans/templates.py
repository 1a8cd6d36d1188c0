"""A program made of the benchmark's orders: a module for each customer, a function for each order.

What a function does is one of ``SHAPES``, by its order's number; every module begins with ``PRELUDE`` and imports from
``CORE``. So what is to be found in the whole program follows from what is to be found in a dozen functions: the SQL twins
join the orders with ``expected`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.plans.adapters import lowering_tasks

CORE = '''import json


def check(value):
    if value is None:
        raise KeyError(value)
    return size(value)


def size(value):
    return len(value)


def log(err):
    from pkg.late import again

    print(err)
    json.dumps(err, default=again)
'''

PRELUDE = '''import os
from pkg import core
from pkg.core import check, log

LIMIT = 3


def tidy(path):
    os.remove(path)


class Store:
    def __init__(self, items):
        self.items = items

    def put(self, item):
        self.items.append(item)
        self.last = item

    def get(self):
        return self.items


class Service(Store):
    def put(self, item):
        super().put(item)
        core.size(item)
        self.count = item

    def drop(self):
        from pkg.late import again

        global LIMIT
        LIMIT = 0
        self.last = again()


'''

LATE = '''from pkg import core


def again():
    return later()


def later():
    return again()
'''

SHAPES = [
    """def NAME(x, y):
    if x:
        z = 1
    elif y:
        z = 2
    else:
        z = 3
    return z
""",
    """def NAME(path):
    data = None
    try:
        data = open(path)
    except (OSError, ValueError) as err:
        log(err)
        raise
    except KeyError:
        return None
    else:
        check(data)
    finally:
        tidy(path)
    return data
""",
    """def NAME(lock, items):
    total = 0
    with lock as held:
        for item in items:
            if item is None:
                continue
            total += item
        else:
            total += held
    return total
""",
    """def NAME(msg):
    match msg:
        case ("go", steps) if steps > 0:
            out = steps
        case _:
            out = 0
    return out
""",
    """def NAME(a, b, c):
    base = a + b

    def inner(k):
        return k + base + b + c

    return inner
""",
    """def NAME(n, debug):
    quiet = True
    if quiet:
        n += 1
    while n > 0:
        n -= 1
        if n == 5:
            break
    if debug:
        if not debug:
            n = 9
    return n
""",
    """def NAME(value):
    if not value:
        raise ValueError(value)
    return check(value)
""",
    """def NAME(value):
    try:
        return check(value)
    except LookupError:
        pass
""",
    """def NAME(box, extra):
    box["k"] = extra
    box.append(extra)
    del box[0]
    extra.name = 1
""",
    """def NAME(rec: dict):
    name = rec["name"]
    size = rec.get("size")
    return {"name": name, "size": size, "tags": []}
""",
    """def NAME(flag):
    if flag:
        found = 1
    print(found)
    return found
    print(flag)
""",
    """def NAME(svc):
    s = Service(svc)
    s.put(svc)
    t = s + (s := LIMIT)
    return [u * t for u in svc if (v := u)]
""",
]


def template_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relpath, src) of the program: its modules and the two that they share."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    shapes = F.array(*[F.lit(s) for s in SHAPES])
    text = lambda k: F.replace(F.element_at(shapes, (k % len(SHAPES) + 1).cast("int")), F.lit("NAME"), F.concat(F.lit("f"), k.cast("string")))
    each = orders.repartition(lowering_tasks(spark), "o_custkey")
    files = each.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("xs"))  # text is made where it is lowered
    body = F.array_join(F.transform("xs", text), "\n\n")
    files = files.select(F.format_string("m%d.py", "o_custkey").alias("relpath"), F.concat(F.lit(PRELUDE), body).alias("src"))
    shared = spark.createDataFrame([("pkg/core.py", CORE), ("pkg/late.py", LATE), ("pkg/__init__.py", "")], "relpath string, src string")
    return files.unionByName(shared)


#: Every order's function, and every module; f.t is the number of its shape.
PROGRAM_SQL = f"""
f as (select 'm' || o_custkey || '.py:f' || o_orderkey as fq, 'm' || o_custkey || '.py' as relpath, o_orderkey % {len(SHAPES)} as t from orders),
m as (select distinct 'm' || o_custkey || '.py' as relpath from orders)
"""


def literal(value) -> str:
    if value is None:
        return "null"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def expected(rows: list[tuple], columns: str, types: str = "") -> str:
    """SQL of the rows (owner, ...) for every function they belong to: the number of a shape ('4.inner' is a function inside
    one), the name of a function of the prelude (':' stands before it) or a whole name in the shared modules. In other cells FILE and SELF stand for the names
    of the module and of the function."""
    names = columns.split(", ")
    kinds = types.split(", ") if types else ["varchar"] * len(names)
    cells = [", ".join(f"cast(replace(replace(cast({n} as varchar), 'FILE', relpath), 'SELF', regexp_replace(fq, '[.]inner$', '')) as {k}) as {n}" for n, k in zip(names, kinds))][0]
    parts = []
    inside = "select f.fq || '.' || split_part(v.owner, '.', 2) as fq, f.relpath, v.* from f join v on cast(split_part(v.owner, '.', 1) as integer) = f.t"
    for where, keep in ((inside, lambda o: str(o)[0].isdigit() and not isinstance(o, int)), ("select f.fq, f.relpath, v.* from f join v on v.owner = f.t", lambda o: isinstance(o, int)), ("select m.relpath || v.owner as fq, m.relpath, v.* from m, v", lambda o: str(o).startswith(":")), ("select v.owner as fq, split_part(v.owner, ':', 1) as relpath, v.* from v", lambda o: str(o)[0].isalpha())):
        own = [r for r in rows if keep(r[0])]
        if own:
            values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in own)
            parts.append(f"select fq, {cells} from (with v(owner, {columns}) as (values {values}) {where})")
    return f"with {PROGRAM_SQL} " + " union all ".join(parts)
