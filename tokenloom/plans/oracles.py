"""DuckDB SQL with the rows of each query in plans.catalogue."""

from __future__ import annotations

from tokenloom.functions.tokens import CODE_KEYWORDS, CODE_MARKS, CODE_SYMBOLS, DIGIT, FUNCTION_WORDS


def _strings(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


POSITIONS = r"""toks as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as a from documents),
 lens as (select doc_id, len(a)::bigint as tokens_len, greatest(len(a) - 1, 0)::bigint as preds_len from toks),
 pos as (select doc_id, unnest(range(len(a)))::int as pos, unnest(a) as tok from toks),
 starts as (select *, (coalesce(sum(preds_len) over (order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as start from lens)"""
GRAMS = """, grams as (select doc_id, pos, tok, lag(tok, 1) over w as t1, lag(tok, 2) over w as t2 from pos window w as (partition by doc_id order by pos)),
 induction as (select doc_id, pos from (select *, min(pos) over (partition by doc_id, t2, t1, tok) as f from grams where t2 is not null) where pos > f),
 pairs as (select doc_id, pos, tok, t1 as prev from grams where t1 is not null),
 b as (select prev, tok, count(*) as c from pairs group by all), o as (select prev, sum(c) as c from b group by all), v as (select count(distinct tok) as v from pos),
 losses as (select p.doc_id, p.pos, -ln((b.c + 1e-4::double) / (o.c::double + 1e-4::double * v.v)) as loss from pairs p join b using (prev, tok) join o using (prev), v),
 eligible as (select l.* from losses l anti join induction i on l.doc_id = i.doc_id and l.pos = i.pos where loss < 1.0)"""
UNIT = "(list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))))"


def _near(name: str, ks: str, offset: int = 0, most: int = 100) -> str:
    """CTEs that end in `name`: vec_id, k, label, similarity."""
    return f"""{name}_s as (select u, (row_number() over (order by vec_id) - 1 - {offset})::int as o from e qualify o between 0 and {most - 1}),
 {name}_c as (select e.vec_id, o, round(list_dot_product(e.u, s.u), 9) as c from e, {name}_s s),
 {name} as (select vec_id, k, o as label, c as similarity from {name}_c join (select unnest([{ks}])::int as k) on o < k qualify row_number() over (partition by vec_id, k order by c desc, o) = 1)"""


E = f"with e as (select vec_id, label, {UNIT} as u from embeddings)"
NEAR = E + ", " + _near("near", "5, 10, 20, 50, 100")
RANKED = NEAR + ", sized as (select k, label, count(*) as size from near group by all), ranked as (select *, row_number() over (partition by k order by size desc, label) as rank from sized), env as (select rank, max(size) as size from ranked group by all)"
SWEEP = E + ", " + ", ".join(_near(f"n{o}", "5, 10, 20, 50, 100", o) for o in (0, 100, 200)) + ", sweep as (" + " union all ".join(f"select *, {o}::int as cfg from n{o}" for o in (0, 100, 200)) + """),
 sized as (select cfg, k, label, count(*) as size from sweep group by all), ranked as (select *, row_number() over (partition by cfg, k order by size desc, label) as rank from sized)"""
TWO = E + ", " + _near("n0", "20", 0, 20) + ", " + _near("n1", "20", 100, 20) + ", cells as (select a.label as la, b.label as lb, count(*) as n from n0 a join n1 b using (vec_id) group by all)"
X, Y = "log10(rank::double)", "log10(size::double)"


def _agreement(by: str, cells: str) -> str:
    on = f"using ({by})" if by else "on true"
    b = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""c as (select {b}sum(n * (n - 1) / 2.0)::double as ij, sum(n * ln(n)) as ee, sum(n)::double as n from {cells} {group}),
 a as (select {b}sum(m * (m - 1) / 2.0)::double as pa, sum(m * ln(m)) as ea from (select {b}la, sum(n)::double as m from {cells} group by {b}la) {group}),
 d as (select {b}sum(m * (m - 1) / 2.0)::double as pb, sum(m * ln(m)) as eb from (select {b}lb, sum(n)::double as m from {cells} group by {b}lb) {group}),
 agreed as (select {b}(ij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) as ari, (ln(n) + (ee - ea - eb) / n) / ((ln(n) - ea / n + ln(n) - eb / n) / 2) as nmi from c join a {on} join d {on})"""


CATEGORY = rf"""case when regexp_replace(tok, '^\s+|\s+$', '', 'g') = '' or contains(tok, chr(10)) then 'FORMATTING' when regexp_matches(tok, '^[!-/:-@\[-`{{-~]+$') then 'SYNTACTIC' when regexp_matches(tok, '{DIGIT}') then 'NUMERIC'
 when lower(tok) in ({_strings(FUNCTION_WORDS)}) then 'FUNCTION_WORDS' when regexp_matches(tok, '^\p{{Lu}}') and length(tok) > 1 then 'PROPER_NOUNS' when {' or '.join(f"contains(tok, '{m}')" for m in CODE_MARKS)} then 'CODE' else 'CONTENT' end"""


def _tokens(cluster: str) -> str:
    return rf"""raw as (select {cluster} as cluster, doc_id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]|\n') as a from documents),
 flat as (select cluster, doc_id, unnest(range(len(a))) as pos, unnest(a) as tok from raw),
 tokens as (select cluster, tok, count(*) as n, min({{'d': doc_id, 'p': pos}}) as first, {CATEGORY} as category from flat group by cluster, tok)"""


TAX = "with " + _tokens("source") + """, sized as (select category, sum(n)::bigint as n from tokens group by all),
 dom as (select cluster, category, (sum(n) over (partition by cluster))::bigint as size from (select cluster, category, sum(n) as n, min(first) as first from tokens group by all) qualify row_number() over (partition by cluster order by n desc, first) = 1),
 top as (select cluster, (row_number() over (partition by cluster order by n desc, first))::int as rank, tok, n from tokens qualify rank <= 20)"""
LANGS = "with " + _tokens("lang") + """, s as (select cluster, category, sum(n)::bigint as n from tokens where cluster in ('en', 'fr') group by all),
 al as (select coalesce(l.category, r.category) as category, coalesce(l.n, 0) as left_n, coalesce(r.n, 0) as right_n from (from s where cluster = 'en') l full join (from s where cluster = 'fr') r on l.category = r.category)"""
PRINTS = r"""with t as (select conv_id || ':' || turn as doc, role as class, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from conversations where role in ('user', 'assistant')),
 k as (select doc, class, unnest(w) as tok from t where len(w) >= 3),
 used as (select doc, class, (('0x' || substr(md5(tok), 1, 6))::bigint % 40)::int as cluster, count(*) as n from k group by all),
 prints as (select *, n / sum(n) over (partition by doc) as p from used),
 av as (select p.class, cluster, sum(p) / any_value(d.docs) as p from prints p join (select class, count(distinct doc) as docs from prints group by class) d on p.class = d.class group by all),
 wide as (select x.cluster, coalesce(sum(p) filter (class = 'user'), 0)::double as h, coalesce(sum(p) filter (class = 'assistant'), 0)::double as a from (select unnest(range(40))::int as cluster) x left join av on x.cluster = av.cluster group by all)"""
def _sampled(share: float) -> str:
    return f"sampled as (select iter, vec_id from embeddings, (select unnest(range(10))::int as iter) qualify row_number() over (partition by iter order by md5(iter || ':' || vec_id), vec_id) <= floor({share} * (select count(*) from embeddings)))"


SAMPLED = _sampled(0.8)
FOLDS = "folds as (select doc_id, quality, seed, ((row_number() over (partition by seed, quality order by md5(seed || ':' || doc_id), doc_id) - 1) % 5)::int as fold from labels, (select unnest(range(5))::int as seed))"


def _confusion(source: str, by: str) -> str:
    return f"""cm as (select {by}, count_if(quality = 1 and predicted = 1) as tp, count_if(quality <> 1 and predicted = 1) as fp, count_if(quality <> 1 and predicted <> 1) as tn, count_if(quality = 1 and predicted <> 1) as fn from {source} group by {by}),
 confusion as (select *, case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn))::double * ((tn + fp) * (tn + fn))) else 0 end::double as mcc,
 (case when tp + fn > 0 then tp / (tp + fn) else 0 end + case when tn + fp > 0 then tn / (tn + fp) else 0 end) / 2 as balanced_accuracy from cm)"""


BOOT = E + ", " + _near("near", "20", 0, 20) + f", {SAMPLED}, cells as (select iter, near.label as la, e.label as lb, count(*) as n from sampled join near using (vec_id) join e using (vec_id) group by all), " + _agreement("iter", "cells")
ORDERED = "with z as (select label, count(*) as size from embeddings group by all), o as (select (row_number() over (order by size desc, label, vec_id) - 1)::int as place, vec_id, label from embeddings join z using (label))"
SCAN = (
    "with s as (select count(*) as size from orders group by o_custkey), d as (select size, count(*) as c from s group by all), p as (select x.size as xmin, d.size, d.c from d x join d on d.size >= x.size), f as (select xmin, sum(c)::bigint as n_tail, 1 + sum(c) / sum(c * ln(size / (xmin - 0.5::double))) as alpha from p group by xmin having sum(c) >= 3),"
    " g as (select xmin, n_tail, alpha, abs(sum(c) over (partition by xmin order by size) / n_tail - (1 - pow((size + 0.5::double) / (xmin - 0.5::double), 1 - alpha))) as gap from p join f using (xmin))"
)
ORACLES: dict[str, str] = {
    "doc_prediction_lengths": f"with {POSITIONS} select * from lens",
    "tokenize_positions": f"with {POSITIONS} select * from pos",
    "flat_index_starts": f"with {POSITIONS} select doc_id, start from starts",
    "flat_index_lookup": f"with {POSITIONS}, n as (select unnest(range(0, (select sum(preds_len) from lens)::bigint, 97)) as flat) select flat, doc_id, flat - start as pos from n join starts on flat >= start and flat < start + preds_len",
    "induction_tokens": f"with {POSITIONS}{GRAMS} select * from induction",
    "token_nll_per_doc": f"with {POSITIONS}{GRAMS} select doc_id, count(*) as n, round(avg(loss), 6) as mean_loss, count_if(loss < 0.1)::bigint as zero_loss from losses group by doc_id",
    "non_induction_zero_loss": f"with {POSITIONS}{GRAMS} select doc_id, pos, round(loss, 6) as loss from eligible",
    "systematic_sample": f"with {POSITIONS}{GRAMS} select doc_id, pos, round(loss, 6) as loss, row_number() over (order by doc_id, pos) - 1 as rank from eligible qualify rank % 50 = 0",
    "similarity_search": E + ", p as (select q.vec_id as query_id, v.vec_id, list_dot_product(v.u, q.u) as c, list_dot_product(list_transform(v.u, lambda x: abs(x)), list_transform(q.u, lambda x: abs(x))) as ac from e q, e v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)"
    " select query_id, vec_id, round(c, 6) as cosine, round(ac, 6) as abs_cosine, round(1 - acos(greatest(-1, least(1, c))) / pi(), 6) as angular, round((c + 1) / 2, 6) as shifted from p",
    "nearest_representative": E + ", " + _near("near", "100") + " select vec_id, label, round(similarity, 6) as similarity from near",
    "assignment_quality": E + ", " + _near("near", "100") + " select round(avg(similarity), 6) as mean, round(stddev_pop(similarity), 6) as std, round(min(similarity), 6) as least, round(max(similarity), 6) as most, round(avg((similarity < 0.1)::int), 6) as weak, round(avg((similarity > 0.3)::int), 6) as strong, round(quantile_cont(similarity, 0.5), 6) as median from near",
    "cluster_medoids": E + ", m as (select a.label, a.vec_id, round(avg(list_dot_product(a.u, b.u)), 9) as m from e a join e b on a.label = b.label group by all) select label, vec_id, round(m, 6) as mean_similarity from m qualify row_number() over (partition by label order by m desc, vec_id) = 1",
    "cluster_sizes": RANKED + " select * from sized",
    "rank_frequency_per_k": RANKED + " select k, label, size, rank::int as rank from ranked",
    "envelope_curve": RANKED + " select rank::int as rank, size from env",
    "envelope_slope_seed_sweep": RANKED + f" select round(regr_slope({Y}, {X}), 6) as slope, count(*) as n from env where rank between 5 and 100",
    "slope_intercept_anchor": RANKED + f" select round(regr_slope({Y}, {X}), 6) as slope, round(regr_intercept({Y}, {X}), 6) as intercept, count(*) as n, round(pow(10, regr_intercept({Y}, {X})), 6) as anchor from env where rank between 1 and 100",
    "slope_fallback_window": RANKED + f", s as (select k, count(*) filter (rank between 10 and 400) as n, regr_slope({Y}, {X}) filter (rank between 10 and 400) as near, count(*) as m, regr_slope({Y}, {X}) as whole from ranked group by k) select k, round(coalesce(case when n >= 3 then near end, case when m >= 3 then whole end), 6) as slope from s",
    "best_config_by_delta": SWEEP + f", env as (select cfg, rank, max(size) as size from ranked group by all), s as (select cfg, regr_slope({Y}, {X}) as slope from env where rank between 5 and 100 group by cfg) select cfg, round(slope, 6) as slope, round(abs(slope + 1.237), 6) as delta from s order by round(abs(slope + 1.237), 9), cfg limit 1",
    "most_active_config": SWEEP + " select cfg, count(distinct label) as active from sweep where k = 100 group by cfg order by active desc, cfg limit 1",
    "slope_heatmap_pivot": SWEEP + f", s as (select cfg, k, case when count(*) >= 3 then round(regr_slope({Y}, {X}), 6) end as slope from ranked where rank between 1 and 100 group by all) select cfg, any_value(slope) filter (k = 20) as k20, any_value(slope) filter (k = 50) as k50, any_value(slope) filter (k = 100) as k100 from s group by cfg",
    "power_law_fit": "with s as (select count(*)::double as size from orders group by o_custkey), x as (select min(size) - 0.5 as xmin from s), r as (select count(*) as n, any_value(xmin) as xmin, sum(ln(size / xmin)) as s, sum(ln(size)) as logs, avg(size) as mean from s, x), a as (select *, 1 + n / s as alpha from r),"
    " b as (select n, alpha, -2 * (n * ln(alpha - 1) + n * (alpha - 1) * ln(xmin) - alpha * logs) + ln(n) as p, -2 * n * (-ln(mean) - 1) + ln(n) as e from a) select n, round(alpha, 6) as alpha, round(p, 6) as bic_power_law, round(e, 6) as bic_exponential, round(e - p, 6) as delta_bic from b",
    "contingency": TWO + " select * from cells",
    "ari_nmi": TWO + ", " + _agreement("", "cells") + " select round(ari, 6) as ari, round(nmi, 6) as nmi from agreed",
    "adjusted_mutual_information": TWO
    + """, t as (select sum(n)::double as t from cells), a as (select sum(n)::double as a from cells group by la), b as (select sum(n)::double as b from cells group by lb),
    p as (select a, b, t, unnest(range(greatest(1, a + b - t)::bigint, least(a, b)::bigint + 1)) as o from a, b, t),
    x as (select sum(o / t * ln(t * o / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(o + 1) - lgamma(a - o + 1) - lgamma(b - o + 1) - lgamma(t - a - b + o + 1))) as emi from p),
    h as (select (select -sum(a / t * ln(a / t)) from a, t) as ha, (select -sum(b / t * ln(b / t)) from b, t) as hb, (select -sum(n / t * ln(n / t)) from cells, t) as hab)
    select round((ha + hb - hab - emi) / ((ha + hb) / 2 - emi), 6) as ami from h, x""",
    "cluster_match_jaccard": TWO + ", j as (select *, n / (sum(n) over (partition by la) + sum(n) over (partition by lb) - n) as jaccard from cells), r as (select *, row_number() over (partition by la order by jaccard desc, lb) as ra, row_number() over (partition by lb order by jaccard desc, la) as rb from j) select la, lb, n, round(jaccard, 6) as jaccard from r where ra = 1 and rb = 1",
    "match_summary": TWO
    + """, j as (select *, sum(n) over (partition by la) as ma, sum(n) over (partition by lb) as mb from cells), q as (select *, n / (ma + mb - n) as jaccard from j), r as (select *, row_number() over (partition by la order by jaccard desc, lb) as ra, row_number() over (partition by lb order by jaccard desc, la) as rb from q),
    m as (select *, rank() over (order by ma) + (count(*) over (partition by ma) - 1) / 2 as ka, rank() over (order by mb) + (count(*) over (partition by mb) - 1) / 2 as kb from (select * from r where ra = 1 and rb = 1))
    select count(*) as pairs, round(avg(jaccard), 6) as jaccard_mean, round(quantile_cont(jaccard, 0.5), 6) as jaccard_median, round(avg((jaccard >= 0.5)::int), 6) as half, round(corr(ma, mb), 6) as pearson, round(corr(ka, kb), 6) as spearman from m""",
    "random_baseline": "with cells as (select label as la, ('0x' || substr(md5(vec_id::varchar), 1, 6))::bigint % 10 as lb, count(*) as n from embeddings group by all), " + _agreement("", "cells") + " select round(ari, 6) as ari, round(nmi, 6) as nmi from agreed",
    "cluster_ordered_top500": ORDERED + " select place, vec_id, label from o where place < 500",
    "submatrix_slice": ORDERED + f", e as (select vec_id, {UNIT} as u from embeddings semi join (select * from o where place < 50) using (vec_id)) select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.u, b.u), 6) as cosine from e a join e b on a.vec_id < b.vec_id",
    "similarity_bands": E + ", " + _near("near", "100") + " select greatest(0, least(4, floor(similarity * 5)))::int as band, count(*) as n from near group by all",
    "similarity_percentiles": E + ", " + _near("near", "100") + " select " + ", ".join(f"round(quantile_cont(similarity, {q / 100}), 6) as p{q}" for q in (5, 25, 50, 75, 95)) + " from near",
    "running_bootstrap": BOOT + " select iter, round(avg(ari) over w, 6) as mean, round(stddev_pop(ari) over w, 6) as std from agreed window w as (order by iter rows unbounded preceding)",
    "fingerprint_ablation": PRINTS + ", b as (select cluster from wide order by abs(round(h - a, 9)) desc, cluster limit 1), rest as (select prints.* from prints anti join b using (cluster)) select doc, class, cluster, round(n / sum(n) over (partition by doc), 6) as p from rest",
    "capped_tokens": r"with t as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as a from conversations where role = 'assistant'), x as (select conv_id, turn, unnest(range(len(a)))::int as pos, unnest(a) as tok from t) select * from x order by md5(conv_id || ':' || turn || ':' || pos), conv_id, turn, pos limit 6000",
    "prompt_draw": r"with d as (select doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')[1:10], ' ') as prompt, row_number() over (order by doc_id) - 1 as number from documents), r as (select i as draw, ('0x' || substr(md5(i::varchar), 1, 12))::bigint % (select count(*) from documents) as number from range(600) t(i)) select draw, doc_id, prompt from r join d using (number)",
    "cluster_fragmentation": TWO + ", p as (select la, n / sum(n) over (partition by la) as p from cells) select la, round(exp(-sum(p * ln(p))), 6) as fragmentation from p group by la",
    "bootstrap_sample": f"with {SAMPLED} select * from sampled",
    "bootstrap_agreement": BOOT
    + " select " + ", ".join(f"round({f}({c}), 6) as {c}_{n}" for c in ("ari", "nmi") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("least", "min"), ("most", "max"))) + " from agreed",
    "resume_remaining": "with " + _sampled(0.01) + " select unnest(range(10))::int as iter except select iter from sampled where iter % 2 = 0",
    "token_categories": TAX + " select * from sized",
    "dominant_category": TAX + " select * from dom",
    "top_tokens_per_cluster": TAX + " select * from top",
    "category_shares": TAX + " select category, n, round(100 * n / sum(n) over (), 6) as share from sized",
    "content_bearing_pct": TAX + " select count(*) as clusters, round(100 * count_if(category in ('CONTENT', 'PROPER_NOUNS')) / count(*), 6) as content_bearing_pct from dom",
    "paper_quanta_counts": TAX + f", m as (select cluster, max(contains(tok, chr(10))::int) as newline, count_if(rank <= 5 and trim(tok) in ({_strings(CODE_SYMBOLS + CODE_KEYWORDS)})) as code from top group by cluster)"
    " select count_if(category = 'NUMERIC')::bigint as numerical, count_if(category = 'FORMATTING' and newline = 1)::bigint as newline, count_if(code >= 2)::bigint as code from dom join m using (cluster)",
    "category_full_outer_align": LANGS + " select * from al",
    "cross_split_pearson": LANGS + " select round(corr(left_n, right_n), 6) as pearson from al",
    "category_lookup_unknown": TAX + ", " + E.removeprefix("with ") + ", " + _near("near", "50", 0, 50) + r", z as (select label as cluster, count(*) as size from near group by all), names as (select regexp_extract(cluster, '\d+')::int as cluster, category from dom) select z.cluster, size, coalesce(category, 'UNKNOWN') as category from z left join names using (cluster)",
    "doc_fingerprint": PRINTS + " select doc, class, cluster, n, round(p, 6) as p from prints",
    "average_fingerprint": PRINTS + " select class, cluster, round(p, 6) as p from av",
    "class_counts": PRINTS + " select class, cluster, sum(n)::bigint as n from used group by all",
    "active_counts": PRINTS + " select class, count(distinct cluster) as active, count(distinct doc) as docs, sum(n)::bigint as tokens from used group by class",
    "divergences": PRINTS + ", z as (select h, a, (h + 1e-10::double) / sum(h + 1e-10::double) over () as p, (a + 1e-10::double) / sum(a + 1e-10::double) over () as q from wide) select round(sum(p * ln(p / q)), 6) as kl_ha, round(sum(q * ln(q / p)), 6) as kl_ah, round((sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / 2, 6) as js, round(sum(h * a) / (sqrt(sum(h * h)) * sqrt(sum(a * a)) + 1e-10::double), 6) as cosine, round(corr(h, a), 6) as pearson from z",
    "top_differing": PRINTS + ", d as (select *, round(h - a, 9) as diff from wide) select cluster, round(h, 6) as h, round(a, 6) as a, round(diff, 6) as diff from d order by abs(d.diff) desc, cluster limit 15",
    "chi_squared_homogeneity": PRINTS + ", c as (select class, cluster, sum(n)::double as n from used group by all), g as (select r.class, k.cluster, r.n * k.n / (select sum(n) from c) as e from (select class, sum(n) as n from c group by 1) r, (select cluster, sum(n) as n from c group by 1) k) select round(sum((coalesce(c.n, 0) - e) ** 2 / e), 6) as statistic, (count(distinct g.cluster) - 1) * (count(distinct g.class) - 1) as dof from g left join c using (class, cluster)",
    "surface_features": PRINTS + " select doc, class, round(-sum(p * ln(p + 1e-12::double)), 6) as entropy, count(*) as active, round(max(p), 6) as peak from prints group by all",
    "stratified_folds": f"with {FOLDS} select * from folds",
    "confusion_per_fold": f"with {FOLDS}, p as (select f.*, (length(text) > 1500)::int as predicted from folds f join documents using (doc_id)), " + _confusion("p", "seed, fold") + " select seed, fold, tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, round(mcc, 6) as mcc, round(balanced_accuracy, 6) as balanced_accuracy from confusion",
    "robustness_flags": r"with q as (select lang, quality, unnest(['full', 'surface', 'single']) as what, unnest([(not regexp_matches(text, '\$\$\$|%%%| \| '))::int, (length(text) > 200)::int, (not contains(text, '%%%'))::int]) as predicted from labels join documents using (doc_id)), " + _confusion("q", "lang, what")
    + ", w as (select lang, any_value(round(mcc, 9)) filter (what = 'full') as f, any_value(round(mcc, 9)) filter (what = 'single') as s, any_value(round(mcc, 9)) filter (what = 'surface') as u from confusion group by lang) select lang, round(f, 6) as \"full\", round(s, 6) as single, round(u, 6) as surface, case when f - u <= 0.05 then 'surface-dominated' when s >= 0.95 * f then 'one-cluster-led' else 'distributed' end as flag from w",
    "tfidf_weights": r"with k as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) as tok from documents), tf as (select doc_id, tok, count(*) as n from k group by all), voc as (select tok, sum(n) as al, count(*) as df from tf group by tok order by al desc, tok limit 10000),"
    " w as (select doc_id, tok, (1 + ln(n)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from tf join voc using (tok)) select doc_id, tok, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w",
    "bag_of_words_terms": r"""with t as (select conv_id || ':' || turn as doc, (role = 'assistant')::int as y, text from conversations where role in ('user', 'assistant') and len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) >= 3),
 tf as (select doc, y, tok, count(*) as n from (select doc, y, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) as tok from t) group by all),
 f as (select doc, y, seed, (row_number() over (partition by seed, y order by md5(seed || ':' || doc), doc) - 1) % 5 as fold from (select distinct doc, y from tf), (select unnest(range(5))::int as seed)),
 m as (select f.*, held from f, (select unnest(range(5))::int as held) where fold <> held),
 sizes as (select seed, held, count(*) as docs from m group by all),
 v as (select seed, held, tok, sum(n) as al, count(*) as df from m join tf using (doc, y) group by all),
 r as (select *, (row_number() over (partition by seed, held order by al desc, tok) - 1)::int as place from v)
 select seed, held, tok, place, round(ln((1 + docs) / (1 + df)) + 1, 6) as idf from r join sizes using (seed, held) where place < 10000""",
    "accent_stripped_terms": r"with k as (select distinct doc_id, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}_]+')) as term from documents) select term, count(*) as df from k group by term",
    "silhouette_search": E + ", d as (select q.vec_id, q.label as own, v.label, avg(acos(greatest(-1, least(1, list_dot_product(v.u, q.u)))) / pi()) as d from e q, e v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id group by all), m as (select vec_id, max(d) filter (label = own) as a, min(d) filter (label <> own) as b from d group by all) select vec_id, round(coalesce((b - a) / greatest(a, b), 0), 6) as silhouette from m",
    "power_law_xmin_scan": SCAN + " select xmin, n_tail, round(alpha, 6) as alpha, round(max(gap), 6) as ks from g group by xmin, n_tail, alpha",
    "power_law_best": SCAN
    + """, b as (select xmin, n_tail, alpha, max(gap) as ks from g group by xmin, n_tail, alpha order by round(max(gap), 9), xmin limit 1),
    t as (select any_value(xmin) as xmin, any_value(n_tail) as n, any_value(alpha) as alpha, any_value(ks) as ks, sum(ln(size)) as s, var_pop(ln(size)) as v, avg(size) as m from s, b where size >= xmin),
    r as (select xmin, n as n_tail, alpha, (alpha - 1) / sqrt(n) as sigma, ks, -2 * (n * ln(alpha - 1) + n * (alpha - 1) * ln(xmin - 0.5) - alpha * s) + ln(n) as p, 2 * s + n * ln(2 * pi() * v) + n + 2 * ln(n) as l, 2 * n * (ln(m) + 1) + ln(n) as e from t)
    select xmin, n_tail, round(alpha, 6) as alpha, round(sigma, 6) as sigma, round(ks, 6) as ks, round(p, 6) as bic_power_law, round(l, 6) as bic_lognormal, round(e, 6) as bic_exponential, case when p <= l and p <= e then 'power_law' when l <= e then 'lognormal' else 'exponential' end as best from r""",
    "generated_region": r"with t as (select conv_id, unnest(range(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')))) as pos from conversations where role = 'assistant') select conv_id, count(*) as n from t where pos >= 9 group by conv_id",
    "parameter_names": "select count(*) as names, sum(p_size)::bigint as size from part where p_name not like '%red%' and p_name not like '%widget%'",
    "noise_dropped_sizes": E + ", " + _near("near", "100") + " select label, count(*) as size from near where similarity >= 0.3 group by label",
    "lively_clusterings": E + ", " + _near("near", "2, 3, 5, 10", 0, 10) + ", good as (select k from near group by k having count(distinct label) >= 5) select k, label, count(*) as size from near semi join good using (k) group by all",
    "capped_k_list": RANKED + " select max(k) as greatest_k, min(k) as least_k, count(distinct k) as ks from sized where k <= 20",
    "successful_iterations": BOOT + ", w as (select unnest(range(12))::int as iter) select iter, round(ari, 6) as ari, round(nmi, 6) as nmi from w left join agreed using (iter) where ari is not null",
    "differences_nulled": PRINTS + " select cluster, case when abs(round(h - a, 9)) >= 0.001 then round(round(h - a, 9), 6) end as diff from wide",
    "clusters_by_frequency": PRINTS + " select cluster, (row_number() over (order by round(h, 9) desc, cluster))::int as place from wide",
    "flat_index_join": f"with {POSITIONS} select event_id * 7 as flat, doc_id, event_id * 7 - start as pos from events join starts on event_id * 7 >= start and event_id * 7 < start + preds_len",
    "nearest_medoid": E + ", m as (select a.label, a.vec_id, round(avg(list_dot_product(a.u, b.u)), 9) as m from e a join e b on a.label = b.label group by all), c as (select label, vec_id as medoid from m qualify row_number() over (partition by label order by m desc, vec_id) = 1), d as (select e.vec_id, c.label, medoid, round(list_dot_product(e.u, x.u), 9) as s from e, c join e x on x.vec_id = medoid)"
    " select vec_id, label, medoid, round(s, 6) as similarity from d qualify row_number() over (partition by vec_id order by s desc, label) = 1",
    "synonyms_folded": "select case lang when 'de' then 'german' when 'fr' then 'french' else lang end as name, count(*) as n from documents group by 1",
    "colours_found": "select case lower(lang) when 'en' then 'blue' when 'es' then 'red' else 'grey' end as colour, count(*) as n from documents group by 1",
    "method_slugs": "select lower(replace(replace(p_brand, '#', '-'), '-', '_')) as slug, case when slug like 'brand!_%' escape '!' then substr(slug, 7) end as rest, count(*) as n from part group by all",
    "flattened_slopes": SWEEP + f", s as (select cfg, k, case when count(*) >= 3 then regr_slope({Y}, {X}) end as slope from ranked where rank between 1 and 100 group by all) select 'offset=' || cfg || '_k=' || k as key, printf('%+.4f', round(slope, 6)) as slope from s where slope is not null",
    "reference_line": RANKED + f", f as (select regr_slope({Y}, {X}) as slope, pow(10, regr_intercept({Y}, {X})) as anchor from env where rank between 1 and 100) select rank::int as rank, round(anchor * pow(rank, slope), 6) as expected from env, f",
    "best_config_clusters": SWEEP + ", b as (select cfg from sweep where k = 100 group by cfg order by count(distinct label) desc, cfg limit 1) select cfg, label, count(*) as size from sweep semi join b using (cfg) where k = 100 group by all",
    "vocabulary_decode": f"with {POSITIONS}, t as (select doc_id, string_agg(tok, ' ' order by pos) as text from pos group by doc_id) select doc_id, coalesce(t.text, '') as text from documents d left join t using (doc_id)",
    "stored_matrix": "select row_number() over (order by vec_id) - 1 as \"row\", len(embedding)::int as dims, round(list_reduce(list_transform(embedding, lambda x: x::double), lambda a, x: a + x), 6) as total from embeddings where embedding is not null",
    "stored_labels": "select row_number() over (order by vec_id) - 1 as \"row\", label from embeddings where label is not null",
    "softmax_nll": "with e as (select vec_id, label, list_transform(embedding, lambda x: 8 * x::double) as l from embeddings) select vec_id, 'sharp' as model, round(ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) + list_max(l) - l[label + 1], 6) as loss from e",
    "categories_by_size": TAX + ", z as (select category, count(*) as clusters, sum(size)::bigint as tokens from dom group by category) select *, (row_number() over (order by tokens desc, category))::int as place, round(100 * clusters / sum(clusters) over (), 2) as clusters_pct, round(100 * tokens / sum(tokens) over (), 2) as tokens_pct from z",
    "categories_common": "with " + _tokens("lang") + ", l as (select distinct category from tokens where cluster = 'en'), r as (select distinct category from tokens where cluster = 'de') select category, 'both' as \"where\" from (from l intersect from r) union all select category, 'any' from (from l union from r)",
    "top_matched_pairs": TWO + ", j as (select *, n / (sum(n) over (partition by la) + sum(n) over (partition by lb) - n) as jaccard from cells), r as (select *, row_number() over (partition by la order by jaccard desc, lb) as ra, row_number() over (partition by lb order by jaccard desc, la) as rb from j) select la, lb, n, round(jaccard, 6) as jaccard from r where ra = 1 and rb = 1 order by round(r.jaccard, 9) desc, la limit 15",
}
ORACLES["silhouette_mean"] = "select round(avg(silhouette), 6) as mean, count(*) as n from (" + ORACLES["silhouette_search"].replace("round(coalesce((b - a) / greatest(a, b), 0), 6)", "coalesce((b - a) / greatest(a, b), 0)") + ")"
ORACLES["stored_lengths"] = ORACLES["doc_prediction_lengths"]
