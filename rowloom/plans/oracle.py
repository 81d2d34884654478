"""The registered queries again, as SQL over the plain tables.

Written from the definitions: keys are joined, children are counted and
numbered by sorting, contexts grow without any early stop.
"""

from __future__ import annotations

from contextlib import contextmanager

from rowloom.plans.params import (
    AUC_STEPS,
    CONTEXT,
    CUTOFFS,
    LABEL_DAYS,
    LEAK,
    SAMPLE_MOMENT,
    SAMPLE_WIDTH,
    STRIPE,
    UNROLLED,
)

NUM, TEXT, DT, BOOL = 0, 1, 2, 3

# (table, split, source, pkey, fkeys, time column, row order, value columns in order, all columns)
_DB = [
    ("benchmark", "item_id", [], None, "item_id", [("item_id", None), ("text", TEXT)]),
    ("conversations", None, [], None, "conv_id, turn", [("conv_id", NUM), ("turn", NUM), ("role", TEXT), ("text", TEXT)]),
    (
        "customer", "c_custkey", [("c_nationkey", "nation")], None, "c_custkey",
        [("c_custkey", None), ("c_name", TEXT), ("c_nationkey", None), ("c_acctbal", NUM), ("c_mktsegment", TEXT)],
    ),
    (
        "documents", "doc_id", [], None, "doc_id",
        [("doc_id", None), ("text", TEXT), ("lang", TEXT), ("source", TEXT), ("n_chars", NUM)],
    ),
    (
        "events", "event_id", [("user_id", "customer")], "ts", "event_id",
        [("event_id", None), ("ts", DT), ("user_id", None), ("event_type", TEXT), ("value", NUM), ("props", TEXT)],
    ),
    ("labels", None, [("doc_id", "documents")], None, "doc_id", [("doc_id", None), ("quality", NUM), ("toxic", NUM)]),
    (
        "lineitem", None, [("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier")], "l_shipdate",
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate",
        [
            ("l_orderkey", None), ("l_partkey", None), ("l_suppkey", None), ("l_linenumber", NUM), ("l_quantity", NUM),
            ("l_extendedprice", NUM), ("l_discount", NUM), ("l_tax", NUM), ("l_returnflag", TEXT), ("l_linestatus", TEXT),
            ("l_shipdate", DT),
        ],
    ),
    ("nation", "n_nationkey", [("n_regionkey", "region")], None, "n_nationkey",
     [("n_nationkey", None), ("n_name", TEXT), ("n_regionkey", None)]),
    (
        "orders", "o_orderkey", [("o_custkey", "customer")], "o_orderdate", "o_orderkey",
        [
            ("o_orderkey", None), ("o_custkey", None), ("o_orderstatus", TEXT), ("o_totalprice", NUM), ("o_orderdate", DT),
            ("o_orderpriority", TEXT),
        ],
    ),
    ("pages", "page_id", [], None, "page_id", [("page_id", None), ("url", TEXT), ("html", TEXT)]),
    (
        "part", "p_partkey", [], None, "p_partkey",
        [("p_partkey", None), ("p_name", TEXT), ("p_brand", TEXT), ("p_type", TEXT), ("p_size", NUM), ("p_retailprice", NUM)],
    ),
    ("region", "r_regionkey", [], None, "r_regionkey", [("r_regionkey", None), ("r_name", TEXT)]),
    (
        "supplier", "s_suppkey", [("s_nationkey", "nation")], None, "s_suppkey",
        [("s_suppkey", None), ("s_name", TEXT), ("s_nationkey", None), ("s_acctbal", NUM)],
    ),
]
_PKEY = {t[0]: t[1] for t in _DB}


def _tables():
    out = [(name, "db", name, *rest) for name, *rest in _DB]
    for task, target, kind in (("customer-churn", "churn", BOOL), ("customer-spend", "spend", NUM)):
        for split in ("test", "train", "val"):
            source = f"(select seed_time, c_custkey, {target} from task_customer where split = '{split}')"
            out.append(
                (task, split, source, None, [("c_custkey", "customer")], "seed_time", "seed_time, c_custkey",
                 [("seed_time", DT), ("c_custkey", None), (target, kind)])
            )
    return out


TABLES = _tables()
CLASSES = {"customer-churn": 1, "customer-spend": 2}


def _columns():
    ids = {}
    for t in sorted(TABLES, key=lambda t: t[0]):
        for c, _ in t[7]:
            ids.setdefault((t[0], c), len(ids))
    return ids


COLUMN_IDS = _columns()


@contextmanager
def _database(names: list[str]):
    """SQL made inside is for a database of these tables alone."""
    global TABLES, COLUMN_IDS
    whole = TABLES, COLUMN_IDS
    TABLES = [t for t in TABLES if t[0] in names]
    COLUMN_IDS = _columns()
    yield
    TABLES, COLUMN_IDS = whole


def _cutoffs() -> str:
    rows = ", ".join(f"(timestamp '{ts}', '{split}')" for ts, split in CUTOFFS)
    return f"""
cutoffs as (select * from (values {rows}) v(ts, split)),
task_customer as (
  select c.split, c.ts as seed_time, o.o_custkey as c_custkey,
         count(case when o.o_orderdate > c.ts then 1 end) = 0 as churn,
         cast(coalesce(sum(case when o.o_orderdate > c.ts then cast(o.o_totalprice as decimal(18,2)) end), 0) as double) as spend
  from cutoffs c join orders o on o.o_orderdate <= c.ts + interval {LABEL_DAYS} day
  group by c.split, c.ts, o.o_custkey
  having count(case when o.o_orderdate <= c.ts then 1 end) > 0
)"""


def _rel(name: str, split: str) -> str:
    return f'r_{name.replace("-", "_")}_{split}'


def _info() -> str:
    counts = " union all ".join(
        f"select {i} as scan_pos, '{t[0]}' as table_name, '{t[1]}' as split, count(*) as num_nodes, "
        f"count(*) * {len(t[7])} as num_cells from {t[2]} x"
        for i, t in enumerate(TABLES)
    )
    return f"""
counts as ({counts}),
info as (
  select scan_pos, table_name || ':' || upper(split[1]) || split[2:] as table_key, table_name, split,
         cast(coalesce(sum(num_nodes) over (order by scan_pos rows between unbounded preceding and 1 preceding), 0) as bigint) as node_offset,
         num_nodes, num_cells
  from counts
)"""


def _offset(name: str, split: str) -> str:
    return f"(select node_offset from info where table_name = '{name}' and split = '{split}')"


def _valid(c: str, kind: int) -> str:
    return f"({c} is not null and not isnan(cast({c} as double)))" if kind == NUM else f"({c} is not null)"


def _rows() -> str:
    parts = []
    for name, split, source, _, _, time_col, order, cols in TABLES:
        ts = f"epoch_us({time_col}) // 1000000" if time_col else "cast(null as bigint)"
        n = " + ".join(f"cast({_valid(c, k)} as int)" for c, k in cols if k is not None) or "0"
        parts.append(
            f"{_rel(name, split)} as (select *, {_offset(name, split)} + row_idx as node_id from "
            f"(select x.*, row_number() over (order by {order}) - 1 as row_idx, {ts} as ts_sec, {n} as n_cells from {source} x))"
        )
    return ",\n".join(parts)


def _nodes() -> str:
    return "nodes as materialized (" + " union all ".join(
        f"select node_id, '{t[0]}' as table_name, '{t[1]}' as split, row_idx, ts_sec, {str(t[1] != 'db').lower()} as is_task, n_cells "
        f"from {_rel(t[0], t[1])}"
        for t in TABLES
    ) + ")"


def _edges() -> str:
    parts = []
    for name, split, _, _, fkeys, _, _, _ in TABLES:
        for pos, (col, parent) in enumerate(fkeys):
            parts.append(
                f"select c.node_id as child_id, {pos} as fk_pos, '{col}' as fk_col, p.node_id as parent_id, '{name}' as child_table, "
                f"'{split}' as child_split, {CLASSES.get(name, 0)} as child_class, c.ts_sec as child_ts, c.n_cells as child_cells, "
                f"'{parent}' as parent_table, p.ts_sec as parent_ts "
                f"from {_rel(name, split)} c join {_rel(parent, 'db')} p on c.{col} = p.{_PKEY[parent]}"
            )
    return "edges as materialized (" + " union all ".join(parts) + ")"


def _dictionary() -> str:
    texts = [f"select {c} as text, 1 as n from {t[2]} x where {c} is not null" for t in TABLES for c, k in t[7] if k == TEXT]
    names = sorted({t[0] for t in TABLES} | {f"{c} of {t}" for t, c in COLUMN_IDS})
    texts += [f"select text, 0 as n from (values {', '.join(f"('{n}')" for n in names)}) v(text)"]
    return f"""
uses as ({' union all '.join(texts)}),
text_dict as (
  select row_number() over (order by sha256(text)) - 1 as text_id, text, n_uses from
  (select text, cast(sum(n) as bigint) as n_uses from uses group by text)
)"""


def _stats() -> str:
    parts, times = [], []
    for name, split, _, _, _, _, _, cols in TABLES:
        source = "train" if split in ("val", "test") else split
        for c, k in cols:
            if k == DT:
                times.append(f"select cast(epoch_us({c}) as double) as x from {_rel(name, split)} where {c} is not null")
            if k in (NUM, BOOL):
                x = f"cast({c} as double)"
                parts.append(
                    f"select '{name}' as table_name, '{split}' as split, '{c}' as col_name, {k} as sem_type, coalesce(avg({x}), 0) as mean, "
                    f"coalesce(nullif(stddev_samp({x}), 0), 1) as std from {_rel(name, source)} where {_valid(c, k)}"
                )
            elif k == TEXT:
                parts.append(f"select '{name}' as table_name, '{split}' as split, '{c}' as col_name, {TEXT} as sem_type, 0.0 as mean, 0.0 as std")
            elif k == DT:
                parts.append(
                    f"select '{name}' as table_name, '{split}' as split, '{c}' as col_name, {DT} as sem_type, "
                    "(select mean from dt) as mean, (select std from dt) as std"
                )
    return f"""
dt as (select count(*) as n, avg(x) as mean, stddev_pop(x) as std from ({' union all '.join(times) or 'select 0.0 as x where false'})),
col_stats as ({' union all '.join(parts)})"""


def _cells() -> str:
    parts = []
    for name, split, _, _, _, _, _, cols in TABLES:
        for pos, (c, k) in enumerate(cols):
            if k is None:
                continue
            raw = {NUM: f"cast({c} as double)", BOOL: f"cast({c} as double)", DT: f"cast(epoch_us({c}) as double)", TEXT: "cast(null as double)"}[k]
            text = c if k == TEXT else "cast(null as varchar)"
            parts.append(
                f"select node_id, {pos} as col_pos, {COLUMN_IDS[(name, c)]} as col_id, {k} as sem_type, '{name}' as table_name, '{split}' as split, "
                f"'{c}' as col_name, {raw} as raw, {text} as text from {_rel(name, split)} where {_valid(c, k)}"
            )
    z = "cast((raw - s.mean) / s.std as float)"
    return f"""
raw_cells as ({' union all '.join(parts)}),
cells as materialized (
  select r.node_id, cast(row_number() over (partition by r.node_id order by col_pos) - 1 as bigint) as cell_ord, r.col_id, r.sem_type,
         case when r.sem_type = 0 then {z} else 0 end as number_value,
         case when r.sem_type = 1 then d.text_id else 0 end as text_id,
         case when r.sem_type = 2 then {z} else 0 end as datetime_value,
         case when r.sem_type = 3 then {z} else 0 end as boolean_value,
         case when r.sem_type = 1 then d.text_id else -1 end as class_value_id
  from raw_cells r
  left join text_dict d on r.text = d.text
  left join col_stats s on r.table_name = s.table_name and r.split = s.split and r.col_name = s.col_name
)"""


BASE = ["cutoffs", "info", "rows"]
_PARTS = {
    "cutoffs": _cutoffs,
    "info": _info,
    "rows": _rows,
    "nodes": _nodes,
    "edges": _edges,
    "dict": _dictionary,
    "stats": _stats,
    "cells": _cells,
}


def with_(*parts: str, more: str = "") -> str:
    text = ",\n".join(_PARTS[p]() for p in parts)
    return "with recursive " + text + (",\n" + more if more else "") + "\n"


GRAPH = [*BASE, "nodes", "edges"]
FULL = [*GRAPH, "dict", "stats", "cells"]


def r4(c: str) -> str:
    return f"round(cast({c} as double), 4) + 0.0"


# -- sampling ----------------------------------------------------------------


def h60(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


CLOSURE = """
closure_walk as (
  select node_id, node_id as ancestor_id, 0 as hops, '' as path from nodes
  union all
  select c.node_id, e.parent_id, c.hops + 1, c.path || lpad(cast(999 - e.fk_pos as varchar), 3, '0')
  from closure_walk c join edges e on e.child_id = c.ancestor_id
),
closure as materialized (select * from closure_walk)"""

ADJACENCY = """
adj as materialized (
  select row_number() over (order by parent_id, child_class, child_ts nulls first, child_id, fk_pos) - 1 as adj_pos, * from edges
)"""


PRIME, MULTIPLIERS, ROUNDS = 2147483647, (1103515245, 742938285), 8


def _mixed(source: str, x: str, s: str, out: str) -> str:
    """``source`` with a column ``out``: a residue of x and s, by two squarings."""
    a, b = MULTIPLIERS
    one = f"(select *, ({x} + {s}) % {PRIME} as {out}_y from {source})"
    two = f"(select *, ({out}_y * {out}_y % {PRIME} + {out}_y * {a}) % {PRIME} as {out}_z from {one})"
    return f"(select * exclude ({out}_y, {out}_z), ({out}_z * {out}_z % {PRIME} + {out}_z * {b} + {s}) % {PRIME} as {out} from {two})"


def _permuted(source: str, x: str) -> str:
    """``source`` with a column ``o``: one pass of x through the permutation of a * b places."""
    source = f"(select *, {x} % a as l0, {x} // a as r0 from {source})"
    for turn in range(ROUNDS):
        l, r = f"l{turn}", f"r{turn}"
        moved, still, side = (l, r, "a") if turn % 2 == 0 else (r, l, "b")
        source = _mixed(source, still, f"s{turn}", "m")
        left = f"({l} + m) % a" if turn % 2 == 0 else l
        right = r if turn % 2 == 0 else f"({r} + m) % b"
        source = f"(select * exclude (m, {l}, {r}), {left} as l{turn + 1}, {right} as r{turn + 1} from {source})"
    return f"(select * exclude (l{ROUNDS}, r{ROUNDS}), r{ROUNDS} * a + l{ROUNDS} as o from {source})"


def draws(asks: str, width: int, name: str, seed: int = 0, epoch: int = 0, head: str | None = None) -> str:
    """CTEs from questions (item_id, seed_id, seed_ts, parent_id, child_class) to sampled places.

    ``seed_ts`` null sees everything. ``head``: task rows of a run that may matter; all by default.
    """
    h = h60(str(seed), str(epoch), repr("d"), "seed_id", "parent_id", "child_class")
    keyed = f"(select *, {h} as h from {name}_n)"
    for j in range(ROUNDS + 4):
        keyed = f"(select * exclude (m), (m + h // {PRIME}) % {PRIME} as s{j} from {_mixed(keyed, str(j + 1), f'h % {PRIME}', 'm')})"
    # The k + 1-st smallest of ``many`` exponential keys, as a sum of gaps.
    gap = _mixed(_mixed(f"(select *, unnest(range(k + 1)) as i from {name}_k where many > k)", "i", f"s{ROUNDS + 2}", "g"), "i", f"s{ROUNDS + 3}", "f")
    number = lambda a, b: f"cast({a} * {PRIME} + {b} as double) / {float(PRIME * PRIME)!r}"
    random = _mixed(_mixed(f"{name}_o", "i", f"s{ROUNDS}", "g"), "i", f"s{ROUNDS + 1}", "f")
    step = f"select item_id, parent_id, child_class, i, o from {_permuted('{0}', '{1}')}"
    keep = "k.item_id = {0}.item_id and k.parent_id = {0}.parent_id and k.child_class = {0}.child_class"
    return f"""
{name}_n as materialized (
  select q.item_id, q.seed_id, q.seed_ts, q.parent_id, q.child_class, min(a.adj_pos) as start, count(*) as n, max(a.fk_pos) + 1 as n_keys,
         (select count(*) from adj z where z.parent_id = q.parent_id and z.child_class = q.child_class and z.child_cells = 0) as n_bare
  from {asks} q join adj a on q.parent_id = a.parent_id and q.child_class = a.child_class
   and (a.child_ts is null or q.seed_ts is null or a.child_ts <= q.seed_ts)
  group by all
),
{name}_k as materialized (
  select *, (n + a - 1) // a as b from (
    select *, case when child_class = 0 then k else n end as many, greatest(least(2, n), cast(floor(sqrt(cast(n as double))) as bigint)) as a
    from (select *, case when child_class = 0 then least(n, {width}) else least(n, {head or 'n'}) end as k from {keyed})
  )
),
{name}_t as materialized (select item_id, parent_id, child_class, sum(-ln(1 - {number('g', 'f')}) / (many - i)) as least_out from {gap} group by all),
{name}_w as (
  {step.format(f'(select *, unnest(range(k)) as i from {name}_k)', 'i')}
  union all
  {step.format(f'(select k.*, w.i, w.o as x from {name}_w w join {name}_k k on {keep.format("w")} where w.o >= k.n)', 'x')}
),
{name}_o as materialized (
  select k.*, w.i, w.o, case when k.many > k.k then 1 - exp(-t.least_out) else 1.0 end as cut
  from {name}_w w join {name}_k k on {keep.format("w")} left join {name}_t t on {keep.format("t")}
  where w.o < k.n
),
{name} as materialized (
  select o.item_id, o.seed_id, o.seed_ts, o.parent_id, o.child_class, a.adj_pos, a.child_id, a.child_cells,
         -ln(1 - {number('g', 'f')} * cut) as key
  from {random} o join adj a on a.adj_pos = o.start + o.o
)"""


def contexts(seeds_sql: str, width: int, seq_len: int, lost: dict[str, int] | None = None, levels: int = UNROLLED) -> str:
    """CTEs ending in ``visits``: every context row that begins inside the budget, in order.

    ``seeds_sql`` gives task_no, seed_id, seed_ts, seed_class; ``lost`` the columns
    that a row of a table may hide. A row that begins behind ``seq_len`` sure cells shows
    nothing, and later levels come after it, so that it is left out and the walk dies out.
    """
    sure = "n.n_cells" + "".join(f" - case when n.table_name = '{t}' then {k} else 0 end" for t, k in (lost or {}).items())
    before = (
        f"coalesce(sum(greatest(0, {sure})) over (partition by v.item_id order by v.level, v.key, v.tie, v.path "
        "rows between unbounded preceding and 1 preceding), 0)"
    )
    out = [
        CLOSURE,
        ADJACENCY,
        f"seeds as ({seeds_sql})",
        "items as (select (cast(task_no as bigint) << 48) + seed_id as item_id, * from seeds)",
        """
v0 as (
  select i.item_id, i.task_no, i.seed_id, i.seed_ts, i.seed_class, c.ancestor_id as node_id, 0 as level, 0.0 as key, cast(0 as bigint) as tie,
         c.path, c.hops as depth
  from items i join closure c on c.node_id = i.seed_id
  qualify row_number() over (partition by i.item_id, c.ancestor_id order by c.path) = 1
)""",
    ]
    for d in range(levels):
        out.append(
            f"""
q{d} as (
  select item_id, seed_id, seed_ts, node_id as parent_id, unnest(list_distinct([0, seed_class])) as child_class
  from v{d} where depth = {d}
)"""
        )
        out.append(draws(f"q{d}", width, f"s{d}"))
        out.append(
            f"""
v{d + 1} as materialized (
  select v.* from (select * from (
    select item_id, task_no, seed_id, seed_ts, seed_class, node_id, level, key, tie, path, depth from v{d}
    union all
    select s.item_id, i.task_no, s.seed_id, s.seed_ts, i.seed_class, c.ancestor_id, {d + 1}, s.key, s.adj_pos, c.path, {d + 1} + c.hops
    from s{d} s join items i on i.item_id = s.item_id join closure c on c.node_id = s.child_id
  )
  qualify row_number() over (partition by item_id, node_id order by level, key, tie, path) = 1) v
  join nodes n on n.node_id = v.node_id qualify {before} < {seq_len}
)"""
        )
    out.append(f"visits as (select * from v{levels})")
    return ",\n".join(out)


def churn_seeds() -> str:
    return " union all ".join(
        f"select {i} as task_no, n.node_id as seed_id, n.ts_sec as seed_ts, 1 as seed_class from nodes n "
        f"where n.table_name = 'customer-churn' and n.split = '{split}' "
        f"and exists (select 1 from {_rel('customer-churn', split)} r where r.node_id = n.node_id and r.churn is not null)"
        for i, split in enumerate(("train", "val", "test"))
    )


def shown(seq_len: int, drops: dict[int, list[int]] | None = None, targets: dict[int, int] | None = None) -> str:
    """CTE ``ctx``: the cells of every context with their positions."""
    hidden = " or ".join(
        f"(v.task_no = {t} and c.col_id in ({', '.join(map(str, ids))}) and (v.node_id = v.seed_id or n.ts_sec is not distinct from v.seed_ts))"
        for t, ids in (drops or {}).items()
        if ids
    )
    target = "case v.task_no " + " ".join(f"when {t} then {c}" for t, c in (targets or {0: -1}).items()) + " end"
    return f"""
ctx as materialized (
  select * from (
    select v.task_no, v.seed_id, v.seed_ts, v.node_id, v.depth, n.table_name, n.is_task, c.* exclude (node_id),
           row_number() over (partition by v.item_id order by v.level, v.key, v.tie, v.path, c.cell_ord) - 1 as pos,
           v.node_id = v.seed_id and c.col_id = {target} as is_target,
           n.is_task or c.col_id = {target} as is_task_node
    from visits v join nodes n on n.node_id = v.node_id join cells c on c.node_id = v.node_id
    {f'where not ({hidden})' if hidden else ''}
  ) where pos < {seq_len}
)"""


CHURN_COL = COLUMN_IDS[("customer-churn", "churn")]


def churn_contexts(more: str = "") -> str:
    text = contexts(churn_seeds(), CONTEXT["width"], CONTEXT["seq_len"]) + ",\n" + shown(
        CONTEXT["seq_len"], targets={0: CHURN_COL, 1: CHURN_COL, 2: CHURN_COL}
    )
    return with_(*FULL, more=text + (",\n" + more if more else ""))


PARENTS = """
parents as materialized (select child_id as node_id, list(parent_id order by fk_pos) as f2p from edges group by child_id)"""

CTX_ROWS = PARENTS + """,
crow as materialized (
  select c.task_no, c.seed_id, c.node_id, c.table_name, count(*) as n, bool_or(c.is_target) as is_target,
         list(c.pos order by c.pos) as q_pos, any_value(p.f2p) as f2p
  from ctx c left join parents p on p.node_id = c.node_id group by all
),
link as materialized (
  select distinct a.task_no, a.seed_id, a.node_id, b.node_id as parent_id, a.n, b.n as m, a.q_pos, b.q_pos as parent_pos
  from (select *, unnest(f2p) as parent_id from crow) a
  join crow b on a.task_no = b.task_no and a.seed_id = b.seed_id and a.parent_id = b.node_id
)"""

PREDICTIONS = f"""
predictions as (
  select 'line-open' as task_id, case when l_orderkey % 2 = 0 then 'val' else 'test' end as split, s.step,
         l_orderkey // 1000 as batch_idx, case when l_linenumber % 3 = 0 then 0 else 3 end as sem_type,
         case when l_linestatus = 'O' then 1.0 else -1.0 end as y,
         round(l_discount * 10 * s.step - l_quantity / 50, 2) as yhat, l_tax < 0.08 as mask
  from lineitem, (values {', '.join(f'({s})' for s in AUC_STEPS)}) s(step)
)"""

LOSS = """
case when sem_type = 3 then greatest(yhat, 0) - yhat * (case when y > 0 then 1 else 0 end) + ln(1 + exp(-abs(yhat)))
     when abs(yhat - y) <= 1 then 0.5 * (yhat - y) * (yhat - y) else abs(yhat - y) - 0.5 end"""

AUC = """
auc as (
  select task_id, split, step, sum(case when y > 0 then r end) as rank_sum, count(case when y > 0 then 1 end) as n_pos,
         count(case when y <= 0 then 1 end) as n_neg
  from (
    select *, rank() over (partition by task_id, split, step order by yhat)
              + (count(*) over (partition by task_id, split, step, yhat) - 1) / 2.0 as r
    from predictions where mask
  ) group by task_id, split, step
),
auc_value as (
  select task_id, split, step, (rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * cast(n_neg as double)) as auc, n_pos, n_neg from auc
)"""

EMPTY_LIST = "cast([] as bigint[])"


def joined(list_sql: str) -> str:
    return f"array_to_string({list_sql}, ',')"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["table_info"] = with_("cutoffs", "info") + (
        "select scan_pos, table_key, table_name, split, node_offset, num_nodes, num_cells from info"
    )
    roles = []
    for name, split, source, pkey, fkeys, time_col, _, _ in TABLES:
        if pkey:
            roles.append(f"select '{name}' as table_name, '{split}' as split, 'pkey' as role, '{pkey}' as col_name, '' as parent_table, "
                         f"count(*) as n_rows, count({pkey}) as n_set, count({pkey}) as n_matched from {source} x")
        for c, p in fkeys:
            roles.append(f"select '{name}', '{split}', 'fkey', '{c}', '{p}', count(*), count({c}), "
                         f"count(case when exists (select 1 from {p} p where p.{_PKEY[p]} = x.{c}) then 1 end) from {source} x")
        if time_col:
            roles.append(f"select '{name}', '{split}', 'time', '{time_col}', '', count(*), count({time_col}), count({time_col}) from {source} x")
    q["table_roles"] = with_("cutoffs") + " union all ".join(roles)
    q["nodes"] = with_(*BASE, "nodes") + "select * from nodes"
    q["nodes_skip_db"] = with_(*BASE, "nodes") + "select * from nodes where split <> 'db'"
    q["edges_fk"] = with_(*GRAPH) + "select * from edges"
    q["edges_typed"] = """
with up as (select c_custkey, row_number() over (order by c_custkey) - 1 as node_id from customer),
n as (select count(*) as k from customer),
down as (
  select o_orderkey, k + row_number() over (order by o_orderkey) - 1 as node_id, o_totalprice,
         case when o_orderkey % 5 <> 0 then o_custkey + case when o_orderkey % 7 = 0 then 0.5 when o_orderkey % 11 = 0 then 1e9 else 0 end end as who
  from orders, n
)
select d.node_id as child_id, 'who' as fk_col, u.node_id as parent_id, case when o_totalprice is null then 0 else 1 end as child_cells
from down d join up u on d.who = u.c_custkey"""
    q["six_parents"] = """
with n as (select (select count(*) from lineitem) as l, (select count(*) from orders) as o, (select count(*) from part) as p)
select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as node_id,
       array_to_string([l + l_orderkey, l + o + l_partkey, l + o + p + l_suppkey, l + l_orderkey, l + o + l_partkey, l + o + p + l_suppkey], ',') as parents
from lineitem, n"""
    q["parents_list"] = with_(*GRAPH) + (
        f"select child_id, {joined('list(parent_id order by fk_pos)')} as parent_ids from edges group by child_id"
    )
    q["children_list"] = with_(*GRAPH) + (
        f"select parent_id, child_id // 4096 as chunk, {joined('list(child_id order by child_id, fk_pos)')} as child_ids "
        "from edges group by parent_id, child_id // 4096"
    )
    q["temporal_children"] = with_(*GRAPH) + (
        "select r.node_id as seed_id, r.parent as parent_id, count(*) as n_children from ("
        + " union all ".join(
            f"select c.node_id, c.ts_sec, p.node_id as parent from {_rel('customer-churn', s)} c "
            f"join {_rel('customer', 'db')} p on p.c_custkey = c.c_custkey"
            for s in ("train", "val", "test")
        )
        + ") r join edges e on e.parent_id = r.parent and e.child_class = 0 and (e.child_ts is null or e.child_ts <= r.ts_sec) "
        "group by r.node_id, r.parent"
    )
    q["cells_long"] = with_(*FULL) + (
        f"select node_id, cell_ord, col_id, sem_type, {r4('number_value')} as number_value, text_id, {r4('datetime_value')} as datetime_value, "
        f"{r4('boolean_value')} as boolean_value, class_value_id from cells"
    )
    q["sem_types"] = with_(*FULL) + "select col_id, sem_type, count(*) as n_cells from cells group by col_id, sem_type"
    q["cells_null_nan"] = """
with x as (
  select o_orderkey, nullif(o_orderstatus, 'P') as status, case when o_orderkey % 7 = 0 then cast('nan' as double) else o_totalprice end as price,
         case when o_orderkey % 5 = 0 then null else o_orderdate end as day
  from orders
),
u as (
  select o_orderkey, 0 as pos, 1 as sem_type, status as text, cast(null as double) as raw from x
  union all select o_orderkey, 1, 0, null, price from x
  union all select o_orderkey, 2, 2, null, cast(epoch_us(day) as double) from x
)
select o_orderkey as node_id, row_number() over (partition by o_orderkey order by pos) - 1 as cell_ord, sem_type, text, raw from u
where (sem_type = 1 and text is not null) or (sem_type <> 1 and raw is not null and not isnan(raw))"""
    stats_out = (
        "select table_name, split, col_name, sem_type, round(mean, 4) + 0.0 as mean, round(std, 4) + 0.0 as std from col_stats where "
    )
    q["col_stats_num"] = with_(*BASE, "stats") + stats_out + "sem_type = 0"
    q["col_stats_bool"] = with_(*BASE, "stats") + stats_out + "sem_type = 3"
    q["col_stats_other"] = with_(*BASE, "stats") + (
        "select table_name, split, col_name, sem_type, round(mean / 1e6, 2) + 0.0 as mean_sec, round(std / 1e6, 2) + 0.0 as std_sec "
        "from col_stats where sem_type in (1, 2)"
    )
    q["datetime_global"] = with_(*BASE, "stats") + "select n, round(mean / 1e6, 2) as mean_sec, round(std / 1e6, 2) as std_sec from dt"
    q["split_stats"] = with_(*BASE, "stats") + stats_out + "split in ('val', 'test') and sem_type in (0, 3)"
    q["zscore_cells"] = with_(*FULL) + (
        "select col_id, count(*) as n, round(avg(number_value), 3) + 0.0 as avg_number, round(avg(datetime_value), 3) + 0.0 as avg_datetime, "
        "round(avg(boolean_value), 3) + 0.0 as avg_boolean, round(cast(min(number_value + datetime_value + boolean_value) as double), 3) + 0.0 as lo, "
        "round(cast(max(number_value + datetime_value + boolean_value) as double), 3) + 0.0 as hi from cells where sem_type <> 1 group by col_id"
    )
    q["infinite_cells"] = (
        "select o_orderstatus, count(*) as n_infinite from (select o_orderstatus, case when o_orderkey % 3 = 0 then cast('inf' as double) "
        "else o_totalprice end as x from orders) where isinf((x - 1000.0) / 10.0) group by o_orderstatus"
    )
    q["text_dict"] = with_("cutoffs", "dict") + "select text_id, text, n_uses from text_dict"
    names = ", ".join(f"({i}, '{c}', '{t}')" for (t, c), i in COLUMN_IDS.items())
    q["column_index"] = with_("cutoffs", "dict") + (
        f"select v.col_id, v.col_name, v.table_name, d.text_id as name_text_id from (values {names}) v(col_id, col_name, table_name) "
        "join text_dict d on d.text = v.col_name || ' of ' || v.table_name"
    )
    q["class_ids"] = with_(*FULL) + (
        "select col_id, class_value_id, count(*) as n from cells where sem_type = 1 group by col_id, class_value_id"
    )
    q["binarize_first"] = (
        "select o_orderkey, case when o_orderkey % 11 <> 5 then o_orderstatus end = (select o_orderstatus from orders order by o_orderkey limit 1) "
        "as is_first from orders"
    )
    q["cast_bool"] = "select doc_id, cast(quality as boolean) as quality, cast(toxic as boolean) as toxic from labels"
    q["first_elem"] = "select vec_id, round(cast(embedding[1] as double), 6) + 0.0 as first_value, label from embeddings"
    q["drop_columns"] = "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders"
    q["drop_null_rows"] = "select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_custkey from orders where nullif(o_orderstatus, 'P') is not null"
    q["dummy_index"] = (
        "select row_number() over (order by o_orderkey) - 1 as dummy, o_orderkey, o_custkey from orders where nullif(o_orderstatus, 'P') is not null"
    )
    q["row_index"] = (
        "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as row_idx, "
        "l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem"
    )
    task_rows = [
        ("local/customer-churn/churn", "customer-churn", "churn"),
        ("local/customer-spend/spend", "customer-spend", "spend"),
        ("local/orders/o_totalprice", "orders", "o_totalprice"),
        ("local/lineitem/l_linestatus", "lineitem", "l_linestatus"),
    ]
    q["seed_ranges"] = with_("cutoffs", "info") + (
        "select t.task_id, s.wanted_split, i.split as found_split, i.node_offset, i.num_nodes from (values "
        + ", ".join(f"('{a}', '{b}')" for a, b, _ in task_rows)
        + ") t(task_id, table_name) cross join (values ('train'), ('val'), ('test')) s(wanted_split) "
        "join info i on i.table_name = t.table_name and (i.split = 'db' or i.split = s.wanted_split)"
    )
    seeds = []
    for i, (task_id, table, target) in enumerate(task_rows):
        split = "train" if table.startswith("customer-") else "db"
        seeds.append(
            f"select {i} as task_no, '{task_id}' as task_id, node_id as seed_id, ts_sec as seed_ts, {CLASSES.get(table, 0)} as seed_class, "
            f"'{table}' as seed_table from {_rel(table, split)} where {target} is not null"
        )
    seeds_cte = "pool as (" + " union all ".join(seeds) + ")"
    q["seeds"] = with_(*BASE, more=seeds_cte) + "select * from pool"
    q["ancestors"] = with_(*GRAPH, more=CLOSURE) + (
        "select node_id, ancestor_id, arg_min(hops, path) as hops, min(path) as path from closure group by node_id, ancestor_id"
    )
    q["node_table_lookup"] = with_(*GRAPH) + (
        "select i.table_key, count(*) as n_edges, count(distinct e.parent_id) as n_nodes from edges e join info i "
        "on e.parent_id >= i.node_offset and e.parent_id < i.node_offset + i.num_nodes group by i.table_key"
    )
    asks = f"asks as (select distinct parent_id as item_id, parent_id as seed_id, cast({SAMPLE_MOMENT} as bigint) as seed_ts, parent_id, 0 as child_class from edges)"
    q["child_sample"] = with_(*GRAPH, more=ADJACENCY + ",\n" + asks + ",\n" + draws("asks", SAMPLE_WIDTH, "s")) + (
        "select parent_id, child_id, adj_pos from s"
    )
    hop = contexts(churn_seeds(), CONTEXT["width"], CONTEXT["seq_len"], levels=2)
    q["expand_one_hop"] = with_(*GRAPH, more=hop) + (
        "select i.task_no, s.seed_id, s.parent_id, s.child_class, s.child_id, s.child_cells from s1 s join items i on i.item_id = s.item_id"
    )
    visits = contexts(churn_seeds(), CONTEXT["width"], CONTEXT["seq_len"])
    q["context_nodes"] = with_(*GRAPH, more=visits) + f"""
select task_no, seed_id, node_pos, node_id, depth, before from (
  select v.task_no, v.seed_id, v.node_id, v.depth,
         row_number() over (partition by v.item_id order by level, key, tie, path) - 1 as node_pos,
         cast(coalesce(sum(n.n_cells) over (partition by v.item_id order by level, key, tie, path rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from visits v join nodes n on n.node_id = v.node_id
) where before < {CONTEXT['seq_len']}"""
    cell_cols = (
        f"pos, node_id, depth, table_name, col_id, sem_type, {r4('number_value')} as number_value, text_id, "
        f"{r4('datetime_value')} as datetime_value, {r4('boolean_value')} as boolean_value, class_value_id, is_target, is_target as mask, is_task_node"
    )
    q["context_cells"] = churn_contexts() + f"select task_no, seed_id, {cell_cols} from ctx"
    leak_seeds = " union all ".join(
        f"select {i} as task_no, node_id as seed_id, ts_sec as seed_ts, 0 as seed_class from {_rel(t, 'db')} where {c} is not null"
        for i, (t, c) in enumerate((("orders", "o_totalprice"), ("lineitem", "l_linestatus")))
    )
    col = lambda t, c: COLUMN_IDS[(t, c)]
    leak = contexts(leak_seeds, LEAK["width"], LEAK["seq_len"], {"orders": 1, "lineitem": 1}) + ",\n" + shown(
        LEAK["seq_len"],
        drops={0: [col("orders", "o_orderstatus")], 1: [col("lineitem", "l_returnflag")]},
        targets={0: col("orders", "o_totalprice"), 1: col("lineitem", "l_linestatus")},
    )
    q["leakage_drop"] = with_(*FULL, more=leak) + "select task_no, seed_id, pos, node_id, depth, col_id, is_target, is_task_node from ctx"
    q["context_summary"] = churn_contexts(CTX_ROWS) + (
        "select c.task_no, c.seed_id, count(*) as n_nodes, count(case when is_target then 1 end) as n_targets, "
        "(select count(*) from link l where l.task_no = c.task_no and l.seed_id = c.seed_id) as n_edges from crow c group by c.task_no, c.seed_id"
    )
    q["context_tables"] = churn_contexts(CTX_ROWS) + (
        "select task_no, seed_id, table_name, count(*) as n_nodes from crow group by task_no, seed_id, table_name"
    )
    q["induced_edges"] = churn_contexts(CTX_ROWS) + "select task_no, seed_id, node_id, parent_id from link"
    up = "list_sort(flatten(list(parent_pos)))"
    q["row_relations"] = churn_contexts(
        CTX_ROWS + f""",
ups as (select task_no, seed_id, node_id, {up} as kv from link group by all),
downs as (select task_no, seed_id, parent_id as node_id, list_sort(flatten(list(q_pos))) as kv from link group by all)"""
    ) + f"""
select r.task_no, r.seed_id, r.node_id, {joined('r.q_pos')} as q_pos, {joined(f'coalesce(u.kv, {EMPTY_LIST})')} as parent_kv,
       {joined(f'list_sort(list_distinct(list_concat(r.q_pos, coalesce(u.kv, {EMPTY_LIST}))))')} as feat_kv,
       {joined(f'coalesce(d.kv, {EMPTY_LIST})')} as nbr_kv
from crow r left join ups u using (task_no, seed_id, node_id) left join downs d using (task_no, seed_id, node_id)"""
    q["column_relations"] = churn_contexts() + (
        f"select task_no, seed_id, table_name, col_id, {joined('list(pos order by pos)')} as col_kv from ctx group by task_no, seed_id, table_name, col_id"
    )
    q["mask_density"] = churn_contexts(CTX_ROWS) + """
select t.task_no, t.seed_id, t.n_cells, t.same + coalesce(l.pairs, 0) as feat_pairs, coalesce(l.pairs, 0) as nbr_pairs, c.col_pairs,
       t.n_cells * t.n_cells as full_pairs
from (select task_no, seed_id, cast(sum(n) as bigint) as n_cells, cast(sum(n * n) as bigint) as same from crow group by task_no, seed_id) t
left join (select task_no, seed_id, cast(sum(n * m) as bigint) as pairs from link group by task_no, seed_id) l using (task_no, seed_id)
join (select task_no, seed_id, cast(sum(k * k) as bigint) as col_pairs from
      (select task_no, seed_id, col_id, count(*) as k from ctx group by task_no, seed_id, col_id) group by task_no, seed_id) c using (task_no, seed_id)"""
    order = seeds_cte + f""",
ordered as (
  select task_no, task_id, seed_id,
         row_number() over (order by md5('{STRIPE['seed']}|{STRIPE['epoch']}|' || task_id || '|' || cast(seed_id as varchar))) - 1 as position
  from pool
),
total as (select count(*) as n from pool)"""
    bs, ws = STRIPE["batch_size"], STRIPE["world_size"]
    per = bs * ws
    places = order + f""",
places as (
  select o.task_no, o.seed_id, j // {per} as batch_idx, (j // {bs}) % {ws} as rank, j % {bs} as slot, j >= t.n as is_wrapped,
         least({bs}, t.n - (j // {per}) * {per} - ((j // {bs}) % {ws}) * {bs}) as true_batch_size
  from total t, range(cast(ceil((select n from total) / {float(per)!r}) * {per} as bigint)) r(j), ordered o where o.position = j % t.n
)"""
    q["epoch_order"] = with_(*BASE, more=order) + "select task_no, task_id, seed_id, position from ordered"
    q["rank_stripe"] = with_(*BASE, more=places) + (
        "select task_no, seed_id, batch_idx, rank, slot, is_wrapped, true_batch_size from places where true_batch_size > 0"
    )
    q["batch_wrap"] = with_(*BASE, more=places) + (
        "select batch_idx, rank, count(*) as n_slots, count(case when is_wrapped then 1 end) as n_wrapped, min(true_batch_size) as true_batch_size "
        "from places where true_batch_size > 0 group by batch_idx, rank"
    )
    q["eval_limit"] = with_(*BASE, more=places) + (
        f"select batch_idx, count(*) as n_slots from places where true_batch_size > 0 and batch_idx < {STRIPE['max_steps']} group by batch_idx"
    )
    q["batch_counts"] = with_(*BASE, more=seeds_cte) + (
        f"select task_id, count(*) as n_items, cast(ceil(count(*) / {float(per)!r}) as bigint) as n_batches from pool group by task_id"
    )
    n = CONTEXT["seq_len"]

    def padded(field: str, pad: str) -> str:
        return joined(f"list_concat(list({field} order by pos), list_resize([{pad}], cast({n} - count(*) as bigint), {pad})[1:{n} - count(*)])")

    q["padded_contexts"] = churn_contexts() + f"""
select task_no, seed_id, count(*) as n_cells, {padded('node_id', '-1')} as node_ids, {padded('col_id', '0')} as col_ids,
       {padded('class_value_id', '-1')} as class_value_ids, {padded('sem_type', '0')} as sem_types, {padded('text_id', '0')} as text_ids,
       {padded('cast(is_target as int)', '0')} as is_targets, {padded('cast(is_task_node as int)', '0')} as is_task_nodes, {padded('0', '1')} as is_padding,
       {n} as width
from ctx group by task_no, seed_id"""
    q["score_batches"] = churn_contexts() + (
        "select task_no, seed_id, round(coalesce(avg(case when sem_type = 0 and not is_target then cast(number_value as double) end), 0), 4) + 0.0 as yhat "
        "from ctx group by task_no, seed_id"
    )
    q["batch_auc"] = churn_contexts() + """
, s as (
  select task_no, seed_id, max(case when is_target then boolean_value end) as y,
         round(coalesce(avg(case when sem_type = 0 and not is_target then cast(number_value as double) end), 0), 4) + 0.0 as yhat
  from ctx group by task_no, seed_id
),
r as (
  select *, rank() over (partition by task_no order by yhat) + (count(*) over (partition by task_no, yhat) - 1) / 2.0 as place from s
),
c as (
  select task_no, sum(case when y > 0 then place end) as rank_sum, count(case when y > 0 then 1 end) as n_pos, count(case when y <= 0 then 1 end) as n_neg
  from r group by task_no
)
select 'TASK' as task_id, ['train', 'val', 'test'][task_no + 1] as split, 0 as step,
       round((rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * cast(n_neg as double)), 6) as auc, n_pos, n_neg from c""".replace("TASK", task_rows[0][0])
    spend_seeds = " union all ".join(
        f"select {i} as task_no, n.node_id as seed_id, n.ts_sec as seed_ts, 2 as seed_class from nodes n "
        f"where n.table_name = 'customer-spend' and n.split = '{split}' "
        f"and exists (select 1 from {_rel('customer-spend', split)} r where r.node_id = n.node_id and {_valid('r.spend', NUM)})"
        for i, split in enumerate(("train", "val", "test"))
    )
    spend_col = COLUMN_IDS[("customer-spend", "spend")]
    spend = contexts(spend_seeds, CONTEXT["width"], CONTEXT["seq_len"]) + ",\n" + shown(CONTEXT["seq_len"], targets={t: spend_col for t in range(3)})
    q["batch_r2"] = with_(*FULL, more=spend) + """
, s as (
  select task_no, seed_id, max(case when is_target then cast(number_value as double) end) as y,
         round(coalesce(avg(case when sem_type = 0 and not is_target then cast(number_value as double) end), 0), 4) + 0.0 as yhat
  from ctx group by task_no, seed_id
)
select 'TASK' as task_id, ['train', 'val', 'test'][task_no + 1] as split, 0 as step,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 5) as r2, count(*) as n from s group by task_no""".replace("TASK", "local/customer-spend/spend")
    batch_rows = f"""
churn_pool as (select *, '{task_rows[0][0]}' as task_id from seeds),
churn_order as (
  select *, row_number() over (order by md5('{STRIPE['seed']}|{STRIPE['epoch']}|' || task_id || '|' || cast(seed_id as varchar))) - 1 as position
  from churn_pool
),
churn_total as (select count(*) as n from churn_pool),
churn_places as (
  select o.task_no, o.seed_id, j // {per} as batch_idx, (j // {bs}) % {ws} as rank, j >= t.n as is_wrapped,
         t.n - (j // {per}) * {per} - ((j // {bs}) % {ws}) * {bs} as own
  from churn_total t, range(cast(ceil((select n from churn_total) / {float(per)!r}) * {per} as bigint)) r(j), churn_order o
  where o.position = j % t.n
),
sizes as (select task_no, seed_id, count(*) as n_cells, count(case when is_target then 1 end) as n_targets from ctx group by task_no, seed_id)"""
    q["padded_batches"] = churn_contexts(batch_rows) + f"""
select {STRIPE['epoch']} as epoch, p.rank, p.batch_idx, count(*) as n_rows, cast(sum(case when is_wrapped then 0 else n_targets end) as bigint) as n_targets,
       cast(sum(case when is_wrapped then {n} else {n} - n_cells end) as bigint) as n_padding
from churn_places p join sizes s using (task_no, seed_id) where own > 0 group by p.rank, p.batch_idx"""
    q["embed_lookup"] = churn_contexts() + (
        "select task_no, seed_id, count(*) as n_names, count(case when sem_type = 1 then 1 end) as n_texts, 64 as dim from ctx group by task_no, seed_id"
    )
    geo = " union all ".join(
        f"select 'geo' as db, {k} as sem_type, '{t}' || {key} as node, '{c}' as col from {t}"
        for t, key, c, k in (
            ("region", "r_regionkey", "r_name", TEXT), ("nation", "n_nationkey", "n_name", TEXT), ("supplier", "s_suppkey", "s_name", TEXT),
            ("supplier", "s_suppkey", "s_acctbal", NUM), ("customer", "c_custkey", "c_name", TEXT), ("customer", "c_custkey", "c_acctbal", NUM),
            ("customer", "c_custkey", "c_mktsegment", TEXT),
        )
    )
    q["union_databases"] = with_(*FULL) + (
        "select 'local' as db, sem_type, count(*) as n_cells, count(distinct node_id) as n_nodes, count(distinct col_id) as n_cols from cells group by sem_type "
        f"union all select db, sem_type, count(*), count(distinct node), count(distinct col) from ({geo}) group by db, sem_type"
    )
    pool_seeds = (
        "select 0 as task_no, n.node_id as seed_id, n.ts_sec as seed_ts, 1 as seed_class from nodes n where n.table_name = 'customer-churn' and n.split = 'val' "
        f"and exists (select 1 from {_rel('customer-churn', 'val')} r where r.node_id = n.node_id and r.churn is not null)"
    )
    whole = with_(*FULL, more=contexts(pool_seeds, CONTEXT["width"], CONTEXT["seq_len"]) + ",\n" + shown(CONTEXT["seq_len"], targets={0: CHURN_COL}))
    with _database(["region", "nation", "supplier", "customer"]):
        geo_seeds = f"select 1 as task_no, node_id as seed_id, ts_sec as seed_ts, 0 as seed_class from {_rel('supplier', 'db')} where {_valid('s_acctbal', NUM)}"
        part = contexts(geo_seeds, CONTEXT["width"], CONTEXT["seq_len"]) + ",\n" + shown(CONTEXT["seq_len"], targets={1: COLUMN_IDS[("supplier", "s_acctbal")]})
        geo_part = with_(*FULL, more=part)
    up = f"{1 << 40} + "
    lifted = (
        cell_cols.replace("node_id,", f"{up}node_id as node_id,").replace("col_id,", f"{up}col_id as col_id,")
        .replace("text_id,", f"case when class_value_id >= 0 then {up}text_id else text_id end as text_id,")
        .replace("class_value_id, is_target,", f"case when class_value_id >= 0 then {up}class_value_id else -1 end as class_value_id, is_target,")
    )
    q["pool_contexts"] = (
        f"select * from ({whole}select task_no, seed_id, {cell_cols} from ctx) union all "
        f"select * from ({geo_part}select task_no, {up}seed_id as seed_id, {lifted} from ctx)"
    )
    head = contexts(churn_seeds(), CONTEXT["width"], CONTEXT["seq_len"], levels=1) + ",\n" + """
q1 as (select item_id, seed_id, seed_ts, node_id as parent_id, 1 as child_class from v1 where depth = 1),""" + draws("q1", 0, "s", head="(1 + n_bare) * n_keys")
    q["task_head"] = with_(*GRAPH, more=head) + (
        "select i.task_no, s.seed_id, s.parent_id, s.child_id, round(s.key, 8) as key from s join items i on i.item_id = s.item_id"
    )
    sums = ", ".join(f"({i}, '{c} of {t}')" for (t, c), i in COLUMN_IDS.items())
    vectors = f"""
ww as (
  select text, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as dim, count(*) as n
  from (select text, unnest(string_split(text, ' ')) as w from text_dict) group by all
),
vec as (select text, sum((dim + 1) * n) / sqrt(sum(n * n)) as s from ww group by text),
names as (select v.i as col_id, vec.s from (values {sums}) v(i, text) join vec on vec.text = v.text)"""
    q["batch_vectors"] = churn_contexts(vectors) + """
select c.task_no, c.seed_id, c.pos, round(coalesce(v.s, 0), 3) + 0.0 as text_sum, round(n.s, 3) + 0.0 as name_sum
from ctx c left join text_dict d on c.class_value_id = d.text_id left join vec v on v.text = d.text join names n on n.col_id = c.col_id"""
    n = CONTEXT["seq_len"]
    most = max(len(t[4]) for t in TABLES)
    fill = lambda e, pad: f"array_to_string(list({e} order by pos) || list_transform(range({n} - count(*)), lambda z: {pad}), ',')"
    ten = lambda c: fill(f"cast(round(cast({c} as double) * 10000) as bigint)", "0::bigint")
    table_no = "case c.table_name " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(sorted({t[0] for t in TABLES}))) + " end"
    blank = "'" + "/".join(["-1"] * most) + "'"
    mine = f"array_to_string((coalesce(p.f2p, cast([] as bigint[])) || list_transform(range({most}), lambda z: -1::bigint))[:{most}], '/')"
    q["padded_values"] = churn_contexts(PARENTS) + f"""
select task_no, seed_id, {ten('number_value')} as number_values, {ten('datetime_value')} as datetime_values, {ten('boolean_value')} as boolean_values,
       {fill('cast(is_target as int)', '0')} as masks, {fill('table_no', '0')} as table_ids, {fill('par', blank)} as parents
from (select c.*, {table_no} as table_no, {mine} as par from ctx c left join parents p on p.node_id = c.node_id)
group by task_no, seed_id"""
    preds = "with " + PREDICTIONS
    q["huber_loss"] = preds + (
        f" select task_id, split, step, round(avg({LOSS}), 6) as loss, count(*) as n from predictions where mask and sem_type = 0 group by task_id, split, step"
    )
    q["bce_loss"] = preds + (
        f" select task_id, split, step, round(avg({LOSS}), 6) as loss, count(*) as n from predictions where mask and sem_type = 3 group by task_id, split, step"
    )
    q["total_loss"] = preds + (
        f" select task_id, split, step, batch_idx, round(sum({LOSS}) / count(*), 6) as loss, count(*) as n_masked from predictions where mask "
        "group by task_id, split, step, batch_idx"
    )
    q["mean_loss"] = preds + (
        f" select task_id, split, step, round(avg(loss), 6) as loss, count(*) as n_batches from (select task_id, split, step, batch_idx, avg({LOSS}) as loss "
        "from predictions where mask group by task_id, split, step, batch_idx) group by task_id, split, step"
    )
    q["roc_auc"] = preds + ",\n" + AUC + " select task_id, split, step, round(auc, 8) as auc, n_pos, n_neg from auc_value"
    q["r2"] = preds + (
        " select task_id, split, step, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 8) as r2, count(*) as n from predictions "
        "where mask group by task_id, split, step"
    )
    q["best_on_val"] = preds + ",\n" + AUC + """
select v.task_id, v.step, round(v.auc, 8) as val, round(t.auc, 8) as test from auc_value v join auc_value t
on v.task_id = t.task_id and v.step = t.step and t.split = 'test'
where v.split = 'val' qualify row_number() over (partition by v.task_id order by v.auc desc, v.step) = 1"""
    d = 64
    q["text_embed"] = with_("cutoffs", "dict", more=f"""
words as (
  select text_id, ('0x' || substr(md5(w), 1, 8))::bigint % {d} as dim, count(*) as n
  from (select text_id, unnest(string_split(text, ' ')) as w from text_dict) group by all
),
norms as (select text_id, sqrt(sum(n * n)) as norm from words group by text_id)""") + (
        "select w.text_id, w.dim, round(w.n / norm, 4) as value from words w join norms using (text_id)"
    )
    x = "cast((o_totalprice - 250000.0) / 144000.0 as float)"
    step = f"pow(2.0, greatest(floor(log2(abs(cast({x} as double)))), -126) - 7)"
    q["bf16_round"] = (
        f"select o_orderkey, case when {x} = 0 then 0 else round_even(cast({x} as double) / {step}, 0) * {step} end as value from orders"
    )
    return q
