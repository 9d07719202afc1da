"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from photonloom.plans.queries import FEATURE_BINS, FEATURE_ROWS, FILE_RULES, GLOBAL, HISTORY, HOUR, MEASURES, OFFSETS, PAYLOAD_END, TAU, TIMING_LAGS, TIMING_MARGIN

E = """p as (select event_id, event_type fly, user_id, value, props, epoch_us(ts) t from events),
e as (select *, row_number() over (partition by fly order by t, event_id) rn, count(*) over (partition by fly) n from p)"""
LAGS = f"""{E}, l0 as (select *, lag(value, 1) over (partition by fly order by rn) x1, lag(value, 2) over (partition by fly order by rn) x2,
  case when rn - 1 < floor(n * 0.5) then 'train' when rn - 1 < floor(n * 0.5) + {HISTORY} then 'purge' when rn - 1 < floor(n * 0.7) then 'validation' when rn - 1 < floor(n * 0.7) + {HISTORY} then 'purge' else 'test' end split from e),
l as (select * from l0 where x2 is not null)"""
SPLIT = LAGS[LAGS.index("case when rn - 1") : LAGS.index(" split from e")]


def _r(a: str, p: str) -> str:
    return f"covar_pop({a}, {p}) / nullif(sqrt(var_pop({a}) * var_pop({p})), 0)"


def _r2(a: str, p: str) -> str:
    return f"1 - avg(({a} - {p}) * ({a} - {p})) / nullif(var_pop({a}), 0)"


def _six(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) {c}" for c in cols)


EMA = f"""with recursive {E}, k as (select *, row_number() over (partition by user_id order by t, event_id) k from p),
b as (select event_id, user_id, k, t, value, value b from k where k = 1
  union all select k.event_id, k.user_id, k.k, k.t, k.value, b.b + (1 - exp(-((k.t - b.t) / 1e6 / {TAU}))) * (k.value - b.b) from b join k on k.user_id = b.user_id and k.k = b.k + 1)"""
LONG = "v as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings)"
ROIS = f"{LONG}, y as (select vec_id, 'label' roi, label::double y from embeddings union all select vec_id, 'cycle', (vec_id % 7)::double from embeddings), k as (select roi, i, covar_pop(x, y) k from v join y using (vec_id) group by all)"
ROI_P = f"{LAGS}, rp as (select fly, user_id, fly || '/' || user_id roi, round(avg(value) / (1 + max(value)), 6) p, round(avg((value < 10)::int::double), 6) zeros from p group by all)"
EVIDENCE = f"{ROI_P}, ev as (select rp.*, s.r, s.late_r from rp left join (select fly, user_id, round({_r('value', 'x1')}, 6) r, round({_r('value', 'x2')}, 6) late_r from l group by all) s using (fly, user_id))"
VECTORS = """v0 as (select vec_id, 's' || vec_id % 5 as session, embedding e, label::double + embedding[4]::double y0, 2 * embedding[22]::double + embedding[6]::double y1,
  row_number() over (partition by vec_id % 5 order by vec_id) rn, count(*) over (partition by vec_id % 5) n from embeddings),
v as (select *, case when rn - 1 < floor(n * 0.5) then 'train' when rn - 1 < floor(n * 0.5) + 4 then 'purge' when rn - 1 < floor(n * 0.7) then 'validation' when rn - 1 < floor(n * 0.7) + 4 then 'purge' else 'test' end split from v0),
y as (select vec_id, session, rn, split, unnest([0, 1])::int response, unnest([y0, y1]) y from v)"""
#: Moments of x and y on training rows, and on training and validation rows together.
FITS = ", ".join(
    f"{f} filter (split {on}) {name}{p}"
    for p, on in (("", "= 'train'"), ("2", "in ('train', 'validation')"))
    for f, name in (("covar_pop(x, y)", "c"), ("var_pop(x)", "v"), ("avg(x)", "mx"), ("avg(y)", "my"), ("var_pop(y)", "vy"))
)
GRID = "[0.001, 0.01, 0.1, 1.0, 10.0]"
TESTED = f"round({_r('y', 'p')}, 6) r, round({_r2('y', 'p')}, 6) r2, round(avg((y - p) * (y - p)), 6) mse, round(avg((y - p) * (y - p)) / first(vy), 6) nmse"
CAL = "coalesce(covar_pop(x1, value) / nullif(var_pop(x1), 0), 0)"

SQL: dict[str, str] = {
    "asof_align": f"with {E} select f.event_id, u.event_id update_id from (select * from p where fly <> 'click') f asof left join (select * from p where fly = 'click') u on f.t >= u.t",
    "asof_payload_filter": f"with {E} select f.event_id, u.event_id update_id, f.t from (select * from p where fly <> 'click') f asof join (select * from p where fly = 'click') u on f.t >= u.t where f.t < {PAYLOAD_END}",
    "asof_offset_sweep": f"""with {E}, o as (select unnest({OFFSETS})::bigint offset_us), f as (select p.fly, p.value, offset_us, t + offset_us t from p, o where fly <> 'click'),
s as (select f.fly, offset_us, count(*) n_matched, round({_r('f.value', 'u.value')}, 6) r from f asof join (select * from p where fly = 'click') u on f.t >= u.t group by all)
select fly, offset_us, n_matched, r, offset_us = first(offset_us) over (partition by fly order by r desc nulls last, offset_us) is_best from s""",
    "timing_sensitivity": f"""with {E}, u as (select t, row_number() over w rn, count(*) over () n, """
    + ", ".join(f"lag(value, {k}) over w v{k}, lag(user_id, {k}) over w w{k}" for k in range(TIMING_LAGS))
    + f""" from p where fly = 'click' window w as (order by t, event_id)), z0 as (select f.*, u.rn ur, u.n un from (select * from p where fly <> 'click') f asof join u on f.t >= u.t),
z as (select fly, t, event_id, value, user_id, row_number() over (partition by fly order by t, event_id) k, count(*) over (partition by fly) m from z0 where ur > {TIMING_LAGS + TIMING_MARGIN} and ur <= un - {TIMING_MARGIN}),
h as (select *, case when k <= floor(m * 0.35) then 'first' when k <= floor(m * 0.7) then 'second' else 'test' end part from z),
o as (select fly, event_id, part, value, user_id, t + offset_us t, offset_us from h, (select unnest({OFFSETS})::bigint offset_us)),
a as (select o.*, u.* exclude (t, rn, n) from o asof join u on o.t >= u.t where v{TIMING_LAGS - 1} is not null),
x as ("""
    + " union all ".join(f"select fly, event_id, part, offset_us, {r} r, {k} l, {y}::double y, {c}{k}::double x from a" for r, y, c in ((0, "value", "v"), (1, "user_id", "w")) for k in range(TIMING_LAGS))
    + f"""), k as (select fly, r, l, covar_pop(x, y) k from x where offset_us = 0 and part <> 'test' group by all),
pj as (select fly, r, part, offset_us, event_id, first(y) y, sum(k * x) pj from x join k using (fly, r, l) group by all),
g as (select fly, r, covar_pop(pj, y) / var_pop(pj) g, avg(y) - covar_pop(pj, y) / var_pop(pj) * avg(pj) b from pj where offset_us = 0 and part <> 'test' group by all),
s as (select fly, r, offset_us, {_r('y', 'g * pj + b')} rr, {_r2('y', '(g * pj + b)')} r2 from pj join g using (fly, r) where part = 'test' group by all),
kk as (select fly, r, l, offset_us, part, covar_pop(x, y) k from x where part <> 'test' group by all), kh as (select a.fly, a.r, a.l, a.offset_us, a.k k1, b.k k2 from kk a join kk b using (fly, r, l, offset_us) where a.part = 'first' and b.part = 'second'),
sh as (select fly, r, offset_us, sqrt(sum(k1 * k1)) st, coalesce({_r('k1', 'k2')}, 0) sh from kh group by all)
select fly, offset_us, count(*) filter (rr > 0) positive_r_count, round(median(rr), 6) median_test_r, round(median(r2), 6) median_test_r2, round(median(st), 6) median_filter_strength, round(median(sh), 6) median_split_half_r from s join sh using (fly, r, offset_us) group by all""",
    "feature_gather": f"""with b as (select row_number() over (order by vec_id) - 1 u, embedding e from embeddings),
x as (select u, """ + ", ".join(f"avg(e[{i + 1}]::double) over (order by u rows between {2 * b + 1} preceding and {2 * b} preceding) f{8 * b + i:02d}" for b in range(2) for i in range(8)) + f""" from b),
f as (select event_id, event_id % 400 \"update\", value from events) select event_id, \"update\", value, {_six('f06', 'f07', 'f08', 'f09')} from f join x on x.u = f.\"update\" where u >= {max(FEATURE_ROWS[0], FEATURE_BINS.history - 1)} and u < {FEATURE_ROWS[1]}""",
    "parameter_replay": f"""with {E}, u as (select t, row_number() over w rn, count(*) over () n, lag(value, 0) over w v0, lag(value, 1) over w v1, lag(value, 2) over w v2 from p where fly = 'click' window w as (order by t, event_id)),
z0 as (select f.fly, f.t, f.event_id, f.value y, u.* exclude (t) from (select * from p where fly <> 'click') f asof join u on f.t >= u.t),
z as (select *, row_number() over (partition by fly order by t, event_id) k, count(*) over (partition by fly) m from z0 where rn > {TIMING_LAGS + TIMING_MARGIN} and rn <= n - {TIMING_MARGIN}),
c as (select fly, covar_pop(v0, y) k0, covar_pop(v1, y) k1, covar_pop(v2, y) k2 from z where k <= floor(m * 0.7) group by fly), j as (select z.*, k0 * v0 + k1 * v1 + k2 * v2 pj from z join c using (fly)),
g as (select fly, covar_pop(pj, y) / var_pop(pj) g, avg(y) - covar_pop(pj, y) / var_pop(pj) * avg(pj) b from j where k <= floor(m * 0.7) group by fly)
select fly, event_id, round(g * pj + b, 6) predicted, y actual from j join g using (fly) where k > floor(m * 0.7)""",
    "reverse_correlation": f"""with {VECTORS}, x as (select vec_id, unnest(e)::double x, generate_subscripts(e, 1) i from v), k as (select session, response, i, covar_pop(x, y) k from x join y using (vec_id) where split = 'train' group by all),
j as (select session, response, vec_id, split, first(y) y, sum(k * x) pj from y join x using (vec_id) join k using (session, response, i) group by all),
g as (select session, response, first(kk) / var_pop(pj) g, avg(y) my, avg(pj) mp, var_pop(y) vy from j join (select session, response, sum(k * k) kk from k group by all) using (session, response) where split = 'train' group by all),
t as (select session, response, y, my + g * (pj - mp) p, vy from j join g using (session, response) where split = 'test') select 'sta' model, session, response, {TESTED} from t group by all""",
    "experiment_single": f"""with {VECTORS}, b as (select y.session, y.response, y.split, e[4]::double x, y from y join v using (vec_id)), m as (select session, response, avg(y) m, stddev_pop(y) sd from b where split = 'train' group by all),
u as (select 'z' unit, session, response, split, x, (y - m) / case when sd < 1e-8 then 1 else sd end y from b join m using (session, response) union all select 'raw', * from b),
s as (select unit, session, response, {FITS} from u group by all),
w as (select unit, session, response, alpha, {_r2('y', '(c / (v + alpha) * (x - mx) + my)')} r2 from u join (select *, unnest({GRID}) alpha from s) using (unit, session, response) where split = 'validation' group by all),
pick as (select * from (select 'session' kind, unit, session, null::int response, alpha, row_number() over (partition by unit, session order by median(r2) desc, alpha) o from w group by unit, session, alpha
  union all select 'response', unit, session, response, alpha, row_number() over (partition by unit, session, response order by r2 desc, alpha) from w
  union all select 'all', unit, null, null, alpha, row_number() over (partition by unit order by median(r2) desc, alpha) from w group by unit, alpha) where o = 1),
f as (select * from (values ('individual_ridge', 'z', 'session'), ('individual_ridge_raw_units', 'raw', 'session'), ('individual_pixel', 'z', 'response'), ('low_rank', 'z', 'all'), ('shared_kernel', 'z', 'none'), ('shared_kernel_raw_units', 'raw', 'none'),
  ('shared_kernel_equal_response', 'z', 'none'), ('hierarchical', 'z', 'none'), ('sta', 'z', 'train')) q(model, unit, kind)),
c as (select f.model, s.*, case when f.kind = 'train' then s.c / s.v else c2 / (v2 + coalesce(alpha, 0)) end beta, case when f.kind = 'train' then mx else mx2 end bx, case when f.kind = 'train' then my else my2 end b0
  from f join s on s.unit = f.unit left join pick on pick.kind = f.kind and pick.unit = f.unit and coalesce(pick.session, s.session) = s.session and coalesce(pick.response, s.response) = s.response),
t as (select model, c.session, c.response, u.y, b0 + beta * (u.x - bx) p, vy from c join u using (unit, session, response) where split = 'test') select model, session, response, {TESTED} from t group by all""",
    "pixel_single_bin": f"""with {VECTORS}, b as (select y.*, i, e[i + 1]::double x from y join v using (vec_id), (select unnest(range(16)) i)),
k as (select session, response, i, covar_pop(x, y) filter (split = 'train') kt, covar_pop(x, y) filter (split = 'validation') kv from b group by all),
l as (select session, response, arg_max(i, kt * kt) px, arg_max(i, kv * kv) late from k group by all), u as (select b.* from b join l using (session, response) where i = px),
s as (select session, response, {FITS} from u group by all),
w as (select session, response, alpha, {_r2('y', '(c / (v + alpha) * (x - mx) + my)')} r2 from u join (select *, unnest({GRID}) alpha from s) using (session, response) where split = 'validation' group by all),
a as (select * from (select *, row_number() over (partition by session, response order by r2 desc, alpha) o from w) where o = 1),
t as (select session, response, row_number() over (partition by session, response order by rn) - 1 j, count(*) over (partition by session, response) m, u.y, my2, my2 + c2 / (v2 + alpha) * (x - mx2) p from u join s using (session, response) join a using (session, response) where split = 'test'),
z as (select session, response, {_r('y', 'p')} tr, {_r2('y', 'p')} t2, {_r2('y', 'my2')} flat from t group by all),
d as (select session, response, j, m, y - avg(y) over q y, p - avg(p) over q p from t window q as (partition by session, response)),
h as (select one.session, one.response, one.m, (two.j - one.j + one.m) % one.m s, abs(sum(one.y * two.p)) c from d one join d two using (session, response) group by all),
n as (select h.session, h.response, (1 + count(*) filter (h.s >= 5 and h.s < h.m - 5 and h.c >= o.c)) / (1.0 + first(h.m) - 10) np from h join h o on o.session = h.session and o.response = h.response and o.s = 0 group by all),
o as (select *, row_number() over (order by np, session || '/' || response) k, count(*) over () cnt from n), q as (select session, response, np, least(1.0, min(np * cnt / k) over (order by k rows between current row and unbounded following)) nq from o)
select session, response, (px // 4)::int pixel_row, (px % 4)::int pixel_col, (3 - px // 4)::int fly_side_row, (3 - px % 4)::int fly_side_col, (late // 4)::int validation_row, (late % 4)::int validation_col, px = late pixel_stable, alpha::double penalty,
round(r2, 6) validation_r2, round(tr, 6) test_r, round(t2, 6) test_r2, round(flat, 6) constant_baseline_test_r2, 0::int peak_lag, round(np, 6) shift_null_p, round(nq, 6) shift_null_q from l join a using (session, response) join z using (session, response) join q using (session, response)""",
    "row_id_zip": f"with {E} select a.rn, a.event_id click_id, b.event_id view_id from e a join e b using (rn) where a.fly = 'click' and b.fly = 'view'",
    "index_lookup": "select l_orderkey, l_linenumber, epoch_us(o_orderdate) t_us from lineitem join orders on l_orderkey = o_orderkey",
    "eligible_history": f"with {E} select event_id, rn from e where rn >= {HISTORY}",
    "lagged_design": f"with {E}, x as (select event_id, rn, " + ", ".join(f"lag(value, {k}) over (partition by fly order by rn) lag_{k:02d}" for k in range(HISTORY)) + f" from e) select * exclude (rn) from x where rn >= {HISTORY}",
    "binned_design": f"with {E}, x as (select event_id, rn, " + ", ".join(f"round(avg(value) over (partition by fly order by rn rows between {(b + 1) * 10 - 1} preceding and {b * 10} preceding), 6) b{b}" for b in range(4)) + " from e) select * exclude (rn) from x where rn >= 40",
    "ema_baseline": f"{EMA} select event_id, round(b, 6) baseline from b",
    "ema_residual": f"{EMA} select event_id, round(value - b, 6) response from b",
    "ema_dff": f"{EMA} select event_id, round((value - b) / greatest(b, 1), 6) response from b",
    "range_median_baseline": f"with {E} select event_id, round(median(value) over (partition by user_id order by t range between {10 * HOUR} preceding and 1 preceding), 6) baseline from p",
    "block_median_residual": f"""with {E}, st as (select fly, t - lag(t) over (partition by fly order by rn) d from e), m as (select fly, greatest(1, round_even({10 * HOUR} / median(d), 0))::bigint b from st group by fly),
q as (select e.*, (rn - 1) // b blk from e join m using (fly)), s as (select fly, blk, min(t) t0, min(rn) r0 from q group by all),
md as (select s.fly, s.blk, s.r0, median(x.value) md from s left join e x on x.fly = s.fly and x.rn < s.r0 and x.t >= s.t0 - {60 * HOUR} group by all),
h as (select md.fly, md.blk, coalesce(md.md, f.value) base from md join e f on f.fly = md.fly and f.rn = greatest(md.r0 - 1, 1))
select q.event_id, round(q.value - h.base, 6) residual from q join h using (fly, blk)""",
    "clock_summary": f"""with {E}, s as (select *, t - lag(t) over (partition by fly order by rn) d from e), m as (select fly, median(d) md from s group by fly)
select fly, count(*) count, min(t) start_us, max(t) end_us, count(*) filter (d <= 0) duplicate_or_reverse, max(d) max_interval_us, count(*) filter (d > 1.5 * md) intervals_over_1p5x_median,
round(first(md), 3) median_interval_us, round(quantile_cont(d, 0.01), 3) p01_interval_us, round(quantile_cont(d, 0.99), 3) p99_interval_us from s join m using (fly) group by fly""",
    "trace_quality": f"""with {E}, s as (select *, lag(value) over (partition by fly order by rn) prev from e), d as (select *, value - prev step from s),
m as (select fly, median(value) md, median(step) ms, max(value) top from d group by fly), j as (select * from d join m using (fly)),
w as (select fly, median(abs(value - md)) mad, median(abs(step - ms)) jump from j group by fly), a as (select * from j join w using (fly))
select fly, count(*) count, round(avg(value), 6) mean, round(first(md), 6) median, round(stddev_pop(value), 6) std, round(stddev_pop(value) / nullif(avg(value), 0), 6) cv, round(min(value), 6) min,
{", ".join(f"round(quantile_cont(value, {q / 100}), 6) p{q:02d}" for q in (1, 5, 95, 99))}, round(max(value), 6) max, count(*) filter (value = 0) zero_count, count(*) filter (value = top) at_max_count,
round((avg(value) filter (rn > n - ceil(n / 10.0)) - avg(value) filter (rn <= floor(n / 10.0))) / nullif(avg(value), 0), 6) decile_change,
count(*) filter (mad > 0 and abs(value - md) > 6 * 1.4826 * mad) robust_outlier_count, count(*) filter (jump > 0 and abs(step - ms) > 8 * 1.4826 * jump) abrupt_jump_count,
round(coalesce(covar_pop(prev, value) filter (prev is not null) / nullif(sqrt(var_pop(prev) filter (prev is not null) * var_pop(value) filter (prev is not null)), 0), 0), 6) lag1_autocorrelation from a group by fly""",
    "session_qc": f"""with {E}, s as (select *, t - lag(t) over (partition by fly order by rn) step, 10000000 + round(value * 1000)::bigint o from e), a as (select s.*, u.event_id update_id from s asof left join (select * from p where fly = 'click') u on s.t >= u.t),
m as (select fly, median(o) md from s group by fly), w as (select fly, first(md) / 1e6 md, quantile_cont(abs(o - md) / 1000, 0.99) far from s join m using (fly) group by fly)
select fly, count(*) frames, count(update_id) matched, round(median(step), 3) median_interval_us, round(avg((value = 0)::int::double), 6) zero_fraction, count(*) filter (step <= 0) = 0 clock_increases, count(update_id) > 0 overlaps_payload,
round(first(md), 6) playback_offset_s, round(first(far), 3) playback_p99_abs_residual_ms from a join w using (fly) group by fly""",
    "split_blocked_50_20_30": f"with {E} select event_id, {SPLIT} split from e",
    "split_blocked_70_30": f"with {E} select event_id, case when rn - 1 < floor(n * 0.7) then 'train' when rn - 1 < floor(n * 0.7) + {HISTORY} then 'purge' else 'test' end split from e",
    "split_global_labels": f"with {E} select event_id, rn - 1 u, case " + " ".join(f"when rn - 1 >= {a} and rn - 1 < {b} then '{k.split('_')[0]}'" for k, (a, b) in GLOBAL.intervals().items()) + " else 'unused' end split from e where fly = 'click'",
    "split_leak_check": f"""with {E}, s as (select fly, rn - 1 u, {SPLIT} split from e), b as (select fly, split, min(u) first, max(u) last from s where split <> 'purge' group by all)
select a.fly, a.split left_split, a.last left_last, c.split right_split, c.first right_first, c.first - {HISTORY} + 1 <= a.last "overlaps" from b a join b c using (fly)
where (a.split, c.split) in (('train', 'validation'), ('validation', 'test'), ('train', 'test'))""",
    "unpivot_long": f"select l_orderkey, l_linenumber, roi, value from (select l_orderkey, l_linenumber, {', '.join(MEASURES)} from lineitem) unpivot (value for roi in ({', '.join(MEASURES)}))",
    "roi_global_index": "with d as (select distinct event_type fly, user_id from events) select fly, user_id, row_number() over (partition by fly order by user_id) - 1 roi_index, row_number() over (order by fly, user_id) - 1 global_roi_index from d",
    "explain_row": f"with {E} select event_id, fly, user_id, rn, t, value, c_name from e left join customer on c_custkey = user_id where event_id = 5",
    "manifest_counts": f"with {E} select fly, {SPLIT} split, count(*) observations, count(distinct user_id) rois from e group by all",
    "split_pivot_counts": f"with {E}, s as (select fly, {SPLIT} split from e) select fly, " + ", ".join(f"count(*) filter (split = '{k}') {k}" for k in ("train", "validation", "test", "purge")) + " from s group by fly",
    "train_zscore": f"""with {E}, s as (select *, {SPLIT} split from e), c as (select fly, avg(value) m, stddev_pop(value) sd from s where split = 'train' group by fly)
select event_id, split, round((value - m) / case when sd < 1e-8 then 1 else sd end, 6) z, sd < 1e-8 zero_variance from s join c using (fly)""",
    "score_columns": f"""with {LAGS}, tv as (select fly, var_pop(value) tv from l where split = 'train' group by fly)
select fly, count(*) n, round({_r('value', 'x1')}, 6) r, round({_r2('value', 'x1')}, 6) r2, round(avg((value - x1) * (value - x1)), 6) mse, round(avg((value - x1) * (value - x1)) / nullif(first(tv), 0), 6) nmse from l join tv using (fly) group by fly""",
    "score_summary": f"""with {LAGS}, s as (select fly, user_id, round({_r2('value', 'x1')}, 9) r2, coalesce(round({_r('value', 'x1')}, 9) > 0.2, false) responsive from l group by all)
select fly, count(r2) scored, round(median(r2), 6) median_r2, round(avg(r2), 6) mean_r2, round(avg((r2 > 0)::int::double), 6) fraction_positive_r2, round(median(r2) filter (responsive), 6) responsive_median_r2 from s group by grouping sets ((), (fly))""",
    "sta_kernel": f"with {ROIS} select roi, i::bigint i, round(k, 6) k from k",
    "sta_argmax_pixel": f"""with {ROIS}, g as (select roi, (i % 16)::bigint pixel, round(sum(k * k), 9) energy from k group by all), t as (select *, row_number() over (partition by roi order by energy desc, pixel) o from g)
select roi, pixel, pixel // 4 pixel_row, pixel % 4 pixel_col, 3 - pixel // 4 flipped_row, 3 - pixel % 4 flipped_col, round(energy, 6) energy from t where o = 1""",
    "calibrated_projection": f"with {LAGS} select fly, round({CAL}, 6) gain, round(avg(value) - {CAL} * avg(x1), 6) intercept from l group by fly",
    "ridge_1d": f"with {LAGS}, b as (select fly, covar_pop(value, x1) / (var_pop(x1) + 0.1) b1, avg(value) my, avg(x1) m1 from l group by fly) select fly, round(b1, 6) b1, round(my - b1 * m1, 6) intercept from b",
    "ridge_2d": f"""with {LAGS}, s as (select fly, var_pop(x1) + 0.1 a, covar_pop(x1, x2) b, var_pop(x2) + 0.1 c, covar_pop(x1, value) u, covar_pop(x2, value) v, avg(value) my, avg(x1) m1, avg(x2) m2 from l group by fly),
w as (select *, (u * c - v * b) / (a * c - b * b) b1, (v * a - u * b) / (a * c - b * b) b2 from s) select fly, round(b1, 6) b1, round(b2, 6) b2, round(my - b1 * m1 - b2 * m2, 6) intercept from w""",
    "predict_from_params": f"with {E}, x as (select event_id, rn, " + ", ".join(f"lag(value, {k}) over (partition by fly order by rn) v{k}" for k in range(4)) + " from e) select event_id, 'roi' || r roi, round(" + " + ".join(f"v{k} * (1.0::double / ({k + 1} + r))" for k in range(4)) + " + r, 6) predicted from x, (select unnest([0, 1, 2]) r) where rn >= 4",
    "vector_projection": f"with {LONG} select a.vec_id, round(sum(a.x * b.x), 6) projection from v a join v b on a.i = b.i and b.vec_id = 0 group by a.vec_id",
    "gram_matrix": f"with {LONG} select a.i::bigint i, b.i::bigint j, round(covar_pop(a.x, b.x), 6) c from v a join v b using (vec_id) group by a.i, b.i",
    "population_average": f"with {E}, m as (select min(n) m from e) select rn, round(avg(value), 6) mean_response, count(*) members, round(median(value), 6) median_response from e, m where rn <= m group by rn",
    "leave_one_out_readout": f"""with {LAGS}, o as (select fly, {CAL} g, avg(value) - {CAL} * avg(x1) b from l group by fly), f as (select fly, {CAL} g, avg(value) - {CAL} * avg(x1) b from l where rn <= greatest(50, floor(n * 0.2)) group by fly)
select t.fly, round(median(o.g), 6) zero_shot_gain, round(median(o.b), 6) zero_shot_bias, count(*) sources, round(first(f.g), 6) few_shot_gain, round(first(f.b), 6) few_shot_bias from o t join o on o.fly <> t.fly join f on f.fly = t.fly group by t.fly""",
    "peer_median_control": f"""with {E}, d as (select fly, t // 86400000000 frame, avg(value) v from p group by all), q as (select a.fly, a.frame, first(a.v) v, median(b.v) m from d a join d b on a.frame = b.frame and a.fly <> b.fly group by all),
f as (select fly, covar_pop(v, m) / (var_pop(m) + 0.1) b1, avg(v) my, avg(m) mm from q group by fly), z as (select q.*, b1 * m + (my - b1 * mm) pr from q join f using (fly))
select fly, count(*) n, round({_r('v', 'pr')}, 6) r, round({_r2('v', 'pr')}, 6) r2 from z group by fly""",
    "circular_shift_null": f"""with {E}, d as (select fly, t // {6 * HOUR} frame, avg(value) v from p group by all), q as (select a.fly, a.v, c.v pr, row_number() over (partition by a.fly order by a.frame) - 1 i, count(*) over (partition by a.fly) n from d a join d c on a.frame = c.frame and c.fly = 'click' where a.fly <> 'click'),
c as (select fly, i, n, v - avg(v) over (partition by fly) a, pr - avg(pr) over (partition by fly) b from q), s as (select x.fly, x.n, (y.i - x.i + x.n) % x.n s, sum(x.a * y.b) d from c x join c y using (fly) group by all),
z as (select fly, abs(d) d0 from s where s = 0) select s.fly, round((1 + count(*) filter (s.s >= 3 and s.s < s.n - 3 and abs(s.d) >= d0)) / (1.0 + first(s.n) - 6), 6) p from s join z using (fly) group by s.fly""",
    "psd_peak": f"""with {E}, c as (select fly, rn - 1 i, n, value - avg(value) over (partition by fly) v from e), f as (select fly, n, unnest(range(1, n // 2 + 1)) k from (select distinct fly, n from c)),
s as (select fly, n, k, sum(v * cos(2 * pi() * ((i * k) % n) / n)) a, sum(v * sin(2 * pi() * ((i * k) % n) / n)) b from c join f using (fly, n) group by all),
o as (select fly, n, k, row_number() over (partition by fly order by round(a * a + b * b, 6) desc, k) o from s) select fly, round(k::double / n, 6) psd_peak_hz from o where o = 1""",
    "block_bootstrap_ci": f"""with {LAGS}, t as (select fly, value a, x1 p, row_number() over (partition by fly order by rn) i, count(*) over (partition by fly) n from l),
u as (select *, sum(a) over w sa, sum(p) over w sp, sum(a * a) over w saa, sum(p * p) over w spp, sum(a * p) over w sap, sum((a - p) * (a - p)) over w see from t window w as (partition by fly order by i)),
z as (select * from u union all select distinct fly, 0, 0, 0, n, 0, 0, 0, 0, 0, 0 from u), f as (select distinct fly, n, least(68, n) w, ceil(n / least(68, n))::bigint m from t),
d as (select fly, n, w, m, rep, k, floor(('0x' || substr(md5('20260929:' || rep || ':' || k), 1, 8))::bigint / 4294967296.0::double * (n - w + 1))::bigint s from (select *, unnest(range(m)) k from (select *, unnest(range(2000)) rep from f))),
b as (select *, s + case when k = m - 1 then (n - 1) % w + 1 else w end e from d),
g as (select b.fly, b.n, rep, """ + ", ".join(f"sum(y.s{c} - x.s{c}) {c}" for c in ("a", "p", "aa", "pp", "ap", "ee")) + """ from b join z x on x.fly = b.fly and x.i = b.s join z y on y.fly = b.fly and y.i = b.e group by all),
r as (select fly, (ap - a * p / n) / sqrt((aa - a * a / n) * (pp - p * p / n)) r, 1 - ee / (aa - a * a / n) r2 from g)
select fly, """ + ", ".join(f"round(quantile_cont({c}, {q}), 6) {c}_{name}" for c in ("r", "r2") for name, q in (("low", 0.025), ("high", 0.975))) + """ from r group by fly""",
    "bh_qvalues": f"with {ROI_P}, k as (select roi, p, row_number() over (order by p, roi) r, count(*) over () m from rp) select roi, p, round(least(1.0, min(p * m / r) over (order by r rows between current row and unbounded following)), 6) q from k",
    "reliability_select": f"with {EVIDENCE} select roi, p, r, late_r, zeros, coalesce(p < 0.3 and r > 0 and late_r > 0 and zeros < 0.2, false) selected from ev",
    "rf_confidence": f"""with {EVIDENCE}, k as (select fly, coalesce(p < 0.4, false) and coalesce(r > 0, false) model, coalesce(user_id % 2 = 0, false) and coalesce(late_r > 0, false) and coalesce(zeros < 0.4, false) more, coalesce(late_r > 0, false) low from ev)
select fly, count(*) filter (model and more) "HIGH_CONFIDENCE_RESPONSIVE", count(*) filter (model and not more) "MODERATE_CONFIDENCE", count(*) filter (not model and low) "LOW_CONFIDENCE", count(*) filter (not model and not low) "NO_DETECTABLE_RF" from k group by fly""",
    "pairwise_energy_corr": f"with {LONG}, m as (select label, i, avg(x * x) e from v group by all) select a.label label_a, b.label label_b, round(coalesce({_r('a.e', 'b.e')}, 0), 6) r from m a join m b on a.i = b.i and a.label < b.label group by all",
    "paired_delta": """with m as (select l_suppkey % 5 fly, l_suppkey roi, round(avg(l_discount), 9) r2 from lineitem where l_returnflag = 'R' group by all), b as (select l_suppkey % 5 fly, l_suppkey roi, round(avg(l_tax), 9) r2 from lineitem where l_returnflag = 'A' group by all),
d as (select m.fly, m.r2 - b.r2 delta from m join b using (fly, roi)), g as (select fly, count(*) n, median(delta) md, avg((delta > 0)::int::double) fi from d group by fly)
select fly, n, round(md, 6) median_delta, round(fi, 6) fraction_improved, null::bigint positive_groups from g
union all select null, count(*), round(median(delta), 6), round(avg((delta > 0)::int::double), 6), (select count(*) from g where md > 0) from d""",
    "kernel_cosine": f"with {LONG}, m as (select label, vec_id % 2 fold, i, avg(x) k from v group by all) select a.label, round(abs(sum(a.k * b.k) / sqrt(sum(a.k * a.k) * sum(b.k * b.k))), 6) abs_cosine from m a join m b on a.label = b.label and a.i = b.i and a.fold = 0 and b.fold = 1 group by a.label",
    "candidate_select": f"""with {LAGS}, c as (select fly, value, unnest([0, 1, 2]) ordinal, unnest(['x1', 'x2', 'both']) kind, unnest([x1, x2, (x1 + x2) / 2]) pr from l), s as (select fly, ordinal, kind, round({_r2('value', 'pr')}, 6) r2 from c group by all),
t as (select *, row_number() over (partition by fly order by r2 desc, ordinal) o from s) select fly, kind, r2 from t where o = 1""",
    "stimulus_identity": "select user_id, count(distinct event_type) kinds from events group by user_id having count(distinct event_type) > 1",
    "csv_profile": "select 'l_orderkey' \"column\", count(*) row_count, count(l_orderkey) nonempty, min(l_orderkey)::double low, max(l_orderkey)::double high from lineitem union all select 'l_returnflag', count(*), count(nullif(l_returnflag, '')), null, null from lineitem union all select 'l_quantity', count(*), count(l_quantity), min(l_quantity), max(l_quantity) from lineitem",
    "file_role": "with s as (select page_id, list_extract(string_split(url, '/'), -1) name, coalesce(list_extract(string_split(url, '/'), 4), '') folder from pages) select page_id, case "
    + " ".join(f"when regexp_matches({dict(name='name', folder='folder', both=chr(39).join(['folder || ', '/', ' || name']))[on]}, '{pattern}') then '{what}'" for on, pattern, what, _ in FILE_RULES)
    + " else 'Unknown' end category, case "
    + " ".join(f"when regexp_matches({dict(name='name', folder='folder', both=chr(39).join(['folder || ', '/', ' || name']))[on]}, '{pattern}') then {str(used).lower()}" for on, pattern, _, used in FILE_RULES)
    + " else false end used from s",
    "json_profile": "select array_to_string(json_keys(props), ',') keys, count(*) n, count(distinct json_extract_string(props, '$.k')) kinds from events group by all",
    "processed_target": f"""with recursive {E}, b as (select event_id, fly, rn, n, t, value, value b from e where rn = 1
  union all select e.event_id, e.fly, e.rn, e.n, e.t, e.value, b.b + (1 - exp(-((e.t - b.t) / 1e6 / {TAU}))) * (e.value - b.b) from b join e on e.fly = b.fly and e.rn = b.rn + 1),
s as (select event_id, fly, value - b y, {SPLIT} split from b where rn >= {HISTORY}), c as (select fly, avg(y) m, stddev_pop(y) sd from s where split = 'train' group by fly)
select event_id, split, round((y - m) / case when sd < 1e-8 then 1 else sd end, 6) z from s join c using (fly)""",
    "registry_upsert": """with o as (select event_id, event_type, 'old' note from events), n as (select event_id + 50 event_id, event_type, 'new' note from events)
select event_id::varchar experiment_id, event_type model, '' fold, note notes from (select * from n union all select * from o where event_id not in (select event_id from n))""",
    "json_diff": """with l as (select event_id id, json_extract_string(props, '$.k') v from events), r as (select event_id - 1 id, json_extract_string(props, '$.k') v from events)
select coalesce(l.id, r.id) id, '/k' path, case when r.id is null then 'left_only' when l.id is null then 'right_only' when abs(l.v::double - r.v::double) <= 1e-8 + 1e-8 * abs(r.v::double) then 'same' else 'differs' end status, abs(l.v::double - r.v::double) delta from l full join r on l.id = r.id""",
    "replay_check": "with a as (select event_id, value from events), c as (select event_id, value + case when event_id % 50 = 0 then 1.0 else 0.0 end v from a where event_id >= 10) select event_id, round(value, 6) saved, round(v, 6) current from a full join c using (event_id) where coalesce(abs(value - v) > 1e-9 + 1e-9 * abs(v), true)",
    "validation_rollup": f"with {EVIDENCE}, k as (select *, row_number() over (order by p, roi) o, count(*) over () m from ev), q as (select r, late_r, round(least(1.0, min(p * m / o) over (order by o rows between current row and unbounded following)), 6) q from k) select count(*) responses, count(*) filter (r > 0.05) validation_selected, count(*) filter (r > 0.05 and late_r > 0) selected_test_positive, count(*) filter (late_r > 0 and q < 0.9) test_positive_and_q from q",
    "dataset_diagnostics": f"""with {E}, s as (select *, {SPLIT} split from e), q as (select fly, max(rn) stop, greatest(1, max(rn) // 4) k from s where split = 'train' group by fly),
o as (select fly, user_id, count(*) c, stddev_pop(value) filter (split = 'train') sd, avg(value) filter (rn > stop - k and rn <= stop) - avg(value) filter (rn <= k) drift from s left join q using (fly) group by all)
select fly, sum(c)::bigint observations, count(*) rois, round(median(sd), 6) median_train_sd, round(median(drift), 6) median_drift from o group by fly""",
}
