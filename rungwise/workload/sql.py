"""SQL text shared by the counterparts: the domain views and a few operators as CTEs."""

from __future__ import annotations

HORIZONS = "(values (1800), (900)) as h(horizon_seconds)"

SPLIT = """case when {0} < timestamp '1998-01-01' then 'development'
     when {0} < timestamp '2000-01-01' then 'validation' else 'holdout' end"""

LADDER = f"""quotes as (
  select l_orderkey as event_id, l_linenumber as n, avg(l_discount) as d, avg(l_tax) as t
  from lineitem group by 1, 2),
ladder as (
  select q.event_id, h.horizon_seconds, cast(q.n as double) as threshold,
    greatest(0.0e0, least(1.0e0, round(0.5e0 + 0.1e0 * ((q.event_id % 8) - q.n)
      + (case when h.horizon_seconds = 1800 then q.d - 0.05e0 else q.t - 0.04e0 end) * 6e0, 6))) as p,
    case when q.n <= q.event_id % 8 then 1.0e0 else 0.0e0 end as label,
    o_orderdate as scheduled_time, o_orderpriority as asset,
    {SPLIT.format('o_orderdate')} as split,
    strftime(o_orderdate, '%Y-%m') as block
  from quotes q join orders on o_orderkey = q.event_id cross join {HORIZONS})"""


def isotonic(source: str, value: str, out: str, weight: str = "1e0") -> str:
    """Least non-increasing fit by the min-max identity, as table ``out`` with column ``fit``."""
    mean = f"sum({weight} * b.{value}) over w / sum({weight}) over w"
    if weight == "1e0":
        mean = f"avg(b.{value}) over w"
    return f"""{out}_spans as (
  select a.event_id, a.horizon_seconds, a.threshold as j, b.threshold as k, {mean} as m
  from {source} a join {source} b on a.event_id = b.event_id
    and a.horizon_seconds = b.horizon_seconds and b.threshold >= a.threshold
  window w as (partition by a.event_id, a.horizon_seconds, a.threshold
    order by b.threshold rows unbounded preceding)),
{out}_caps as (
  select event_id, horizon_seconds, k as i, max(m) over (
    partition by event_id, horizon_seconds, j order by k desc rows unbounded preceding) as best
  from {out}_spans),
{out} as (
  select event_id, horizon_seconds, i as threshold, min(best) as fit
  from {out}_caps group by 1, 2, 3)"""


TRAIN = """sizes as (
  select horizon_seconds, event_id, count(*) as n from ladder where split = 'development' group by 1, 2),
counted as (select horizon_seconds, count(*) as e from sizes group by 1),
train as (
  select l.horizon_seconds, l.p, l.label as y, sum(1e0 / (c.e * s.n)) as w,
    ln(greatest(1e-6, least(1 - 1e-6, l.p))) as lp,
    ln(1 - greatest(1e-6, least(1 - 1e-6, l.p))) as lq
  from ladder l join sizes s on l.horizon_seconds = s.horizon_seconds and l.event_id = s.event_id
    join counted c on c.horizon_seconds = l.horizon_seconds
  where l.split = 'development' group by 1, 2, 3)"""

PLATT = """platt(horizon_seconds, step, a, b) as (
  select distinct horizon_seconds, 0, 0e0, 1e0 from train
  union all
  select horizon_seconds, step + 1,
    a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12),
    b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (
    select n.horizon_seconds, n.step, n.a, n.b,
      sum(w * (s - y)) as g1, sum(w * (s - y) * x) + 1e-3 * n.b as g2,
      sum(w * s * (1 - s)) as h11, sum(w * s * (1 - s) * x) as h12,
      sum(w * s * (1 - s) * x * x) + 1e-3 as h22
    from (select n.*, t.w, t.y, t.lp - t.lq as x, 1 / (1 + exp(-(n.a + n.b * (t.lp - t.lq)))) as s
          from platt n join train t on n.horizon_seconds = t.horizon_seconds where n.step < 9) n
    group by 1, 2, 3, 4) q),
platt_fit as (select horizon_seconds, a, b from platt where step = 9)"""

BETA = """beta(horizon_seconds, step, a, b, c) as (
  select distinct horizon_seconds, 0, 0e0, 1e0, 1e0 from train
  union all
  select horizon_seconds, step + 1,
    a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det,
    b - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
    c - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det
  from (
    select *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13)
      + h13 * (h12 * h23 - h22 * h13) as det
    from (
      select n.horizon_seconds, n.step, n.a, n.b, n.c,
        sum(w * (s - y)) as g1, sum(w * (s - y) * x1) + 1e-3 * n.b as g2,
        sum(w * (s - y) * x2) + 1e-3 * n.c as g3,
        sum(w * s * (1 - s)) as h11, sum(w * s * (1 - s) * x1) as h12,
        sum(w * s * (1 - s) * x2) as h13, sum(w * s * (1 - s) * x1 * x1) + 1e-3 as h22,
        sum(w * s * (1 - s) * x1 * x2) as h23, sum(w * s * (1 - s) * x2 * x2) + 1e-3 as h33
      from (select n.*, t.w, t.y, t.lp as x1, -t.lq as x2,
              1 / (1 + exp(-(n.a + n.b * t.lp - n.c * t.lq))) as s
            from beta n join train t on n.horizon_seconds = t.horizon_seconds where n.step < 10) n
      group by 1, 2, 3, 4, 5) q) q2),
beta_fit as (select horizon_seconds, a, b, c from beta where step = 10)"""

CALIBRATED = """calibrated as (
  select l.*, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(f.a + f.b * (lp - lq)))))) as p_platt,
    greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(g.a + g.b * lp - g.c * lq))))) as p_beta
  from (select *, ln(greatest(1e-6, least(1 - 1e-6, p))) as lp,
          ln(1 - greatest(1e-6, least(1 - 1e-6, p))) as lq from ladder) l
    join platt_fit f on f.horizon_seconds = l.horizon_seconds
    join beta_fit g on g.horizon_seconds = l.horizon_seconds)"""


def predictions() -> str:
    """All five methods per row, as table ``predicted`` (needs a recursive WITH)."""
    return ",\n".join(
        [
            LADDER,
            TRAIN,
            PLATT,
            BETA,
            CALIBRATED,
            isotonic("ladder", "p", "raw_fit"),
            isotonic("calibrated", "p_beta", "beta_pav"),
            """predicted as (
  select c.event_id, c.horizon_seconds, c.threshold, c.label, c.split, c.block, c.asset, c.p as raw,
    r.fit as pav_raw, c.p_platt as platt, c.p_beta as beta, b.fit as pav_beta
  from calibrated c
    join raw_fit r on r.event_id = c.event_id and r.horizon_seconds = c.horizon_seconds
      and r.threshold = c.threshold
    join beta_pav b on b.event_id = c.event_id and b.horizon_seconds = c.horizon_seconds
      and b.threshold = c.threshold)""",
        ]
    )


METHODS = ("raw", "pav_raw", "platt", "beta", "pav_beta")


def log_loss(p: str, y: str = "label") -> str:
    c = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"-({y} * ln({c}) + (1 - {y}) * ln(1 - {c}))"


def event_losses(source: str = "predicted", methods=METHODS) -> str:
    """Event means of both losses per method, as table ``event_loss``."""
    parts = ", ".join(
        f"avg(({m} - label) * ({m} - label)) as {m}_brier, avg({log_loss(m)}) as {m}_log"
        for m in methods
    )
    return f"""event_loss as (
  select split, horizon_seconds, event_id, asset, block, count(*) as n, {parts}
  from {source} group by 1, 2, 3, 4, 5)"""


def edges(source: str = "predicted", methods=METHODS) -> str:
    """Rising edges and violating events per slice and method, as table ``rising``."""
    steps = ", ".join(
        f"case when lead({m}) over w - {m} > 1e-12 then 1 else 0 end as {m}" for m in methods
    )
    sums = ", ".join(f"sum({m}) as {m}" for m in methods)
    unions = " union all ".join(
        f"select split, horizon_seconds, '{m}' as method, cast(sum({m}) as bigint) as edges, "
        f"count(case when {m} > 0 then 1 end) as violating_events from ev group by 1, 2"
        for m in methods
    )
    return f"""steps as (
  select split, horizon_seconds, event_id, {steps} from {source}
  window w as (partition by event_id, horizon_seconds order by threshold)),
ev as (select split, horizon_seconds, event_id, {sums} from steps group by 1, 2, 3),
rising as ({unions})"""


COMPARISONS = (
    ("pav_raw_vs_raw", "raw", "pav_raw"),
    ("beta_vs_raw", "raw", "beta"),
    ("pav_beta_vs_beta", "beta", "pav_beta"),
    ("pav_beta_vs_raw", "raw", "pav_beta"),
)


def draws(seed: str, rep: str, slot: str, draw: str, bound: str, salts: tuple[int, int]) -> str:
    """The counter-based generator as nested scalar SQL over explicit column names."""
    p = 2147483647

    def fifth(x: str) -> str:
        square = f"(({x}) * ({x}) % {p})"
        return f"(({square} * {square} % {p}) * ({x}) % {p})"

    start = (
        f"((cast({seed} as bigint) * 1000003 + cast({rep} as bigint) * 7919"
        f" + cast({slot} as bigint) * 104729 + (cast({draw} as bigint) + 1) * 15485863) % {p})"
    )
    return start, [fifth("x0")] + [fifth(f"((x{i + 1} + {s}) % {p})") for i, s in enumerate(salts)]


def drawn(source: str, seed: str, rep: str, slot: str, draw: str, salts, name: str, keep: str) -> str:
    """Three chained selects computing a draw ``u`` without repeating sub-expressions."""
    start, rounds = draws(seed, rep, slot, draw, "1", salts)
    return f"""{name}_0 as (select {keep}, {start} as x0 from {source}),
{name}_1 as (select {keep}, {rounds[0]} as x1 from {name}_0),
{name}_2 as (select {keep}, {rounds[1]} as x2 from {name}_1),
{name} as (select {keep}, {rounds[2]} as u from {name}_2)"""


def bootstrap(diff_source: str, columns: str, seed: int, resamples: int) -> str:
    """Replicate means of ``columns`` from one row per event (event_id, block), as ``reps``."""
    averages = ", ".join(f"avg({c}) as {c}" for c in columns.split(", "))
    return f"""placed as (
  select *, row_number() over (partition by block order by event_id) - 1 as event_index
  from {diff_source}),
block_sizes as (
  select block, count(*) as n, row_number() over (order by block) - 1 as block_index
  from placed group by block),
n_blocks as (select count(*) as b from block_sizes),
slots as (
  select r.r as rep, s.s as slot, b from n_blocks, range({resamples}) r(r), range(b) s(s)),
{drawn('slots', str(seed), 'rep', 'slot', '0', (374761393, 668265263), 'bd', 'rep, slot, b')},
chosen as (
  select rep, slot, k.block, k.n from bd join block_sizes k on k.block_index = bd.u % bd.b),
event_slots as (select rep, slot, block, n, unnest(range(n)) as draw from chosen),
{drawn('event_slots', str(seed), 'rep', 'slot', 'draw', (1274126177, 97531), 'ed', 'rep, slot, block, n')},
reps as (
  select rep, {averages} from ed join placed p on p.block = ed.block and p.event_index = ed.u % ed.n
  group by rep)"""


HISTORY = """history as (
  select user_id as token, {ts} as ts, least(value, 100.0) / 100.0 as p from events),
contract as (
  select distinct user_id as token, date_trunc('day', ts) as on_day,
    date_diff('day', date '1970-01-01', cast(ts as date)) * 1000000 + user_id // 10 as event_id,
    date_trunc('day', ts) + interval 12 hour as event_end,
    case when ts < timestamp '2024-01-16' then 'first' else 'second' end as split
  from events)"""


def asof(horizon_rows: str) -> str:
    """As-of facts per (token, cutoff) of ``horizon_rows``, as table ``found``."""
    return f"""pts as (select token, ts, min(p) as p, min(p) <> max(p) as conflict from history group by 1, 2),
asked as (select distinct token, cutoff from {horizon_rows}),
mixed as (
  select token, ts, 0 as kind, p, conflict, null::timestamp as cutoff from pts
  union all select token, cutoff, 1, null, null, cutoff from asked),
scanned as (
  select token, cutoff, kind, last_value(case when kind = 0 then ts end ignore nulls) over w as point_ts,
    last_value(p ignore nulls) over w as p, coalesce(bool_or(conflict) over w, false) as conflict
  from mixed window w as (partition by token order by ts, kind rows unbounded preceding)),
found as (
  select token, cutoff, point_ts, p, conflict, epoch_us(cutoff) - epoch_us(point_ts) as age
  from scanned where kind = 1)"""


def asof_reason(limit: int) -> str:
    return f"""case when conflict then 'conflicting_probabilities_at_one_timestamp'
  when point_ts is null then 'no_point_at_or_before_cutoff'
  when age > {limit} * 1000000::bigint then 'latest_point_exceeds_max_staleness' end"""


CONDITION = f"""condition as (
  select o_orderkey as condition_id, o_custkey * 10000 + year(o_orderdate) as event_id,
    o_orderdate + interval 12 hour as target_at,
    case when o_orderstatus = 'F' then 0.0e0 else 1.0e0 end as candidate,
    {SPLIT.format('o_orderdate')} as split
  from orders),
log as (
  select l_orderkey as condition_id, l_shipdate as mined, o.ts as block_ts,
    l_partkey || '-' || l_suppkey as tx_hash,
    l_linenumber as log_index, l_returnflag = 'R' as removed,
    case when l_linestatus = 'O' then 1 else 0 end as yes,
    case when l_tax = 0 then case when l_linestatus = 'O' then 1 else 0 end
         else case when l_linestatus = 'O' then 0 else 1 end end as no
  from lineitem left join (select distinct o_orderdate as ts from orders) o on o.ts = l_shipdate)"""

GRACE = 51861600

CLASSIFIED = f"""in_window as (
  select l.* from log l join condition c on c.condition_id = l.condition_id
  where block_ts is null or block_ts >= date_trunc('day', target_at)
    and block_ts < date_trunc('day', target_at) + interval 1 day + interval {GRACE} second),
distinct_log as (
  select condition_id, mined, block_ts, tx_hash, log_index, min(removed) as removed, min(yes) as yes, min(no) as no
  from in_window group by 1, 2, 3, 4, 5),
per_condition as (
  select condition_id, count(*) as n, min(removed) as removed, min(yes) as yes, min(no) as no,
    min(block_ts) as block_ts, min(tx_hash) as tx_hash, min(log_index) as log_index
  from distinct_log group by 1),
resolved as (
  select c.*, p.block_ts,
    case when n is null then 'missing'
      when n > 1 or removed or yes + no <> 1 or p.block_ts is null or block_ts < target_at
        or block_ts > target_at + interval {GRACE} second then 'ambiguous'
      when yes <> candidate then 'gamma_disagreement' else 'agreed' end as status,
    case when n is null then 'no ConditionResolution log in the configured window'
      when n > 1 then 'found ' || n || ' distinct ConditionResolution logs'
      when removed then 'the only resolution log is removed or lacks finality state'
      when yes + no <> 1 then 'unsupported payout vector [' || yes || ', ' || no || ']'
      when p.block_ts is null then 'the block of the only resolution log is not in the block table'
      when block_ts < target_at then 'resolution block predates the scheduled target'
      when block_ts > target_at + interval {GRACE} second
        then 'resolution block is later than the protocol target-plus-grace deadline'
      when yes <> candidate then 'canonical payout disagrees with Gamma candidate'
      else 'canonical payout agrees with Gamma candidate' end as reason
  from condition c left join per_condition p on p.condition_id = c.condition_id)"""

MARKETS = """lines as (
  select l_orderkey as k, l_linenumber as n, min(l_extendedprice) as price,
    cast(min(l_quantity) as bigint) as q, min(l_returnflag) as rf
  from lineitem group by 1, 2),
ev as (
  select o_orderkey as k, cast(o_orderkey as varchar) as event_id,
    case when o_totalprice < 10000 then null
      else o_orderpriority || ' above ___ on ' || strftime(o_orderdate, '%Y-%m-%d') || '?' end as title,
    o_orderpriority as asset, o_orderdate, o_totalprice > 490000 as bad_date,
    o_orderstatus <> 'P' as closed, o_totalprice, (select count(*) from lines l where l.k = o_orderkey) as total
  from orders),
event_rule as (
  select k, event_id, r.* from ev cross join lateral (values
    (1, 'missing_event_title', title is null),
    (2, 'event_title_regex_mismatch', title is not null and asset = '5-LOW'),
    (3, 'asset_not_allowed', title is not null and asset in ('5-LOW', '4-NOT SPECIFIED')),
    (4, 'event_not_closed', not closed),
    (5, 'invalid_event_end_date', bad_date),
    (6, 'event_outside_discovery_half_open_interval', not bad_date
      and (o_orderdate < timestamp '1995-06-01' or o_orderdate >= timestamp '2001-06-01')),
    (7, 'event_not_in_any_split', not bad_date
      and (o_orderdate < timestamp '1995-01-01' or o_orderdate >= timestamp '2001-01-01')),
    (8, 'missing_nested_markets', total = 0)) as r(pos, reason, fires) where fires),
judged as (
  select l.*, ev.event_id, ev.asset, ev.o_orderdate from ev join lines l on l.k = ev.k
  where ev.k not in (select k from event_rule)),
market_rule as (
  select k, n, event_id, r.* from judged cross join lateral (values
    (1, 'missing_market_id', q = 15),
    (2, 'missing_condition_id', q = 14),
    (3, 'missing_group_item_title', q = 1),
    (4, 'invalid_group_item_threshold', q = 2),
    (5, 'question_does_not_match_event_template', q = 3 or q = 1),
    (6, 'market_not_closed', q = 4),
    (7, 'order_book_not_enabled', q = 5),
    (8, 'resolution_status_mismatch', q = 6),
    (9, 'invalid_market_end_date', q = 8),
    (10, 'market_end_does_not_match_event_end', q = 7),
    (11, 'invalid_outcomes', q = 10),
    (12, 'outcomes_mismatch', q = 9),
    (13, 'invalid_outcome_prices', q = 12),
    (14, 'non_terminal_gamma_outcome_prices', q = 11),
    (15, 'invalid_clob_token_ids', q = 13)) as r(pos, reason, fires) where fires),
passed as (select j.* from judged j where q > 15),
rechecked as (
  select j.k, j.event_id, count(*) as total, count(case when q > 15 then 1 end) as kept,
    count(distinct case when q > 15 then price end) as prices
  from judged j group by 1, 2),
late_rule as (
  select k, event_id, r.* from rechecked cross join lateral (values
    (11, 'duplicate_thresholds_after_market_filter', prices <> kept),
    (12, 'too_few_strictly_eligible_markets', kept < 2),
    (13, 'nested_market_failed_strict_filter', kept <> total)) as r(pos, reason, fires) where fires),
chosen as (
  select p.*, case when o_orderdate < timestamp '1998-01-01' then 'development'
      when o_orderdate < timestamp '2000-01-01' then 'validation' else 'holdout' end as split
  from passed p where p.k not in (select k from late_rule))"""


def query(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + "\n" + body if ctes else body
