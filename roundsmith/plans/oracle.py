"""The same domain tables in DuckDB SQL, as common table expressions for the oracle queries."""

from __future__ import annotations

from roundsmith.fixtures import DOMAIN

_HAV = "2*6371.0*asin(sqrt(least(1.0, pow(sin(radians({2}-{0})/2),2)+cos(radians({0}))*cos(radians({2}))*pow(sin(radians({3}-{1})/2),2))))"


def km(a: str, b: str, c: str, d: str) -> str:
    return _HAV.format(a, b, c, d)


_DERIVED = """
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY booking_setup_id ORDER BY createdon DESC, rule DESC) rn FROM setup) WHERE rn = 1),
parsed AS (SELECT *, rule LIKE '%<years%' hy, rule LIKE '%<period>daily%' hd, rule LIKE '%<weeks%' hw, rule LIKE '%<months%' hm,
  nullif(regexp_extract(rule,'<weeks[^>]*?every=''([^'']+)''',1),'') nw, nullif(regexp_extract(rule,'<months[^>]*?every=''([^'']+)''',1),'') nm,
  nullif(regexp_extract(rule,'(?s)<period>daily.*?every=''([^'']+)''',1),'') nd, regexp_extract_all(rule,'<days>([^<]*)</days>',1) AS days,
  nullif(regexp_extract(rule,'<day>([^<]*)</day>',1),'') dy, nullif(regexp_extract(rule,'<weekday>([^<]*)</weekday>',1),'') wd, nullif(regexp_extract(rule,'<weekdef>([^<]*)</weekdef>',1),'') wf,
  TRY_CAST(substr(st,7,4)||'-'||substr(st,1,2)||'-'||substr(st,4,2) AS DATE) start_date FROM (SELECT *, regexp_extract(rule,'<start>(.{10})',1) st FROM latest)),
other AS (SELECT booking_setup_id, fl_id, products, regexp_extract_all(rule,'<days>([^<]*)</days>',1) d2 FROM setup WHERE status = 1 AND rule LIKE '%<weeks every=''1''%'),
split AS (SELECT DISTINCT a.booking_setup_id, TRUE AS sp FROM parsed a JOIN other b ON a.fl_id = b.fl_id AND a.products = b.products AND a.booking_setup_id <> b.booking_setup_id
  WHERE a.rule LIKE '%<weeks every=''1''%' AND len(b.d2) > 0 AND coalesce(a.days[1],'') <> b.d2[1]),
typed AS (SELECT p.*, coalesce(sp, FALSE) AS split, CASE WHEN hy THEN 'Yearly' WHEN hd THEN 'Daily' WHEN hw AND (len(days) > 1 OR coalesce(sp, FALSE)) THEN 'Weekly - Multi Day' WHEN hw THEN 'Weekly' WHEN hm AND rule LIKE '%<weekdef>%' THEN 'Monthly - Week Pattern' WHEN hm THEN 'Monthly - Fixed Date' END frequency_type,
  round(CASE WHEN hy THEN 1.0 WHEN hd THEN 365.0 WHEN hw AND nw IS NOT NULL THEN 52.0::DOUBLE/nw::DOUBLE*len(days) WHEN hm AND nm IS NOT NULL THEN 12.0::DOUBLE/nm::DOUBLE END, 2) sql_spy,
  CASE WHEN hy THEN 'Yearly' WHEN hd AND nd IS NOT NULL THEN nd||' Daily' WHEN hw AND nw IS NOT NULL THEN nw||' Weekly' WHEN hm AND nm IS NOT NULL THEN nm||' Monthly' END recurrence_frequency,
  CASE WHEN hy THEN 1 WHEN hd AND nd IS NOT NULL THEN nd::INT WHEN hw AND nw IS NOT NULL THEN nw::INT WHEN hm AND nm IS NOT NULL THEN nm::INT END num_recurrences FROM parsed p LEFT JOIN split USING (booking_setup_id)),
placed0 AS (SELECT *, CASE WHEN hd THEN NULL WHEN hw AND len(days) > 1 THEN array_to_string(days[1:4], ',') WHEN hm THEN coalesce(wd::INT, dayofweek(start_date))::VARCHAR WHEN hw THEN coalesce(days[1]::INT, dy::INT, wd::INT)::VARCHAR WHEN hy THEN dayofweek(start_date)::VARCHAR END dow,
  CASE WHEN frequency_type = 'Weekly' AND start_date IS NOT NULL THEN ((date_diff('day', DATE '2025-05-19', start_date) // 7) % 4 + 4) % 4 + 1 WHEN frequency_type = 'Monthly - Week Pattern' AND wf IS NOT NULL THEN wf::INT WHEN frequency_type IN ('Monthly - Fixed Date','Yearly') AND start_date IS NOT NULL THEN (day(start_date)-1)//7+1 END::INT week_number,
  CASE WHEN frequency_type IN ('Yearly','Daily','Weekly - Multi Day') THEN 'Valid'
    WHEN frequency_type = 'Weekly' AND start_date IS NOT NULL AND len(days) > 0 THEN CASE WHEN dayofweek(start_date) <= days[1]::INT THEN 'Valid' ELSE 'Invalid' END
    WHEN frequency_type = 'Monthly - Fixed Date' AND start_date IS NOT NULL AND dy IS NOT NULL THEN CASE WHEN day(start_date) <= dy::INT THEN 'Valid' ELSE 'Invalid' END
    WHEN frequency_type = 'Monthly - Week Pattern' AND start_date IS NOT NULL AND wd IS NOT NULL THEN CASE WHEN start_date <= date_trunc('month', start_date)::DATE + ((wd::INT - dayofweek(date_trunc('month', start_date)) + 7) % 7 + (wf::INT-1)*7)::INT THEN 'Valid' ELSE 'Invalid' END END valid FROM typed),
derived AS (SELECT p.* EXCLUDE (dow), coalesce(dow,'') dow_number,
  coalesce(array_to_string(list_transform(string_split(dow, ','), lambda c: ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][c::INT+1]), ','), '') sql_dow_name,
  coalesce(valid,'') is_valid_start_date,
  coalesce(CASE WHEN frequency_type NOT IN ('Monthly - Fixed Date','Monthly - Week Pattern','Yearly') THEN 'N/A' WHEN recurrence_frequency = '1 Monthly' THEN 'N/A' WHEN recurrence_frequency = 'Yearly' THEN monthname(start_date) WHEN valid = 'Valid' THEN monthname(start_date) WHEN valid = 'Invalid' THEN monthname(start_date + INTERVAL 1 MONTH) END, '') drop_month,
  CASE WHEN frequency_type = 'Weekly' AND valid = 'Invalid' THEN week_number % 4 + 1 ELSE week_number END::INT drop_week, l.fl_name, l.city, l.address, l.latitude, l.longitude
  FROM placed0 p LEFT JOIN location l USING (fl_id)),
marked AS (SELECT *, CASE WHEN preferred_resource LIKE '%Admin%' THEN 'admin only' WHEN frequency_type = 'Yearly' THEN 'yearly' WHEN frequency_type = 'Daily' THEN 'daily' WHEN frequency_type = 'Monthly - Fixed Date' THEN 'fixed date' WHEN frequency_type IS NULL OR trim(frequency_type) IN ('','NULL') THEN 'no type'
  WHEN frequency_type = 'Monthly - Week Pattern' AND dow_number IN ('0','6') THEN 'weekend pattern' WHEN frequency_type = 'Monthly - Week Pattern' AND week_number = 0 THEN 'week zero' END exclusion_reason FROM derived),
work0 AS (SELECT *, CASE WHEN frequency_type LIKE '%Monthly%' THEN 12.0::DOUBLE/num_recurrences WHEN frequency_type LIKE '%Weekly%' THEN 52.0::DOUBLE/num_recurrences END services_per_year,
  CASE WHEN coalesce(new_duration, service_duration) = 0 THEN 15.0 ELSE coalesce(new_duration, service_duration) END::DOUBLE effective_duration FROM marked WHERE exclusion_reason IS NULL),
work AS (SELECT *, services_per_year/12 services_per_month, effective_duration > 480 duration_flagged, CASE WHEN effective_duration <= 480 THEN effective_duration END capacity_duration,
  CASE WHEN effective_duration <= 480 THEN effective_duration END*services_per_year/12/60 monthly_contrib_hrs,
  CASE dow_number WHEN '0' THEN 'Sunday' WHEN '1' THEN 'Monday' WHEN '2' THEN 'Tuesday' WHEN '3' THEN 'Wednesday' WHEN '4' THEN 'Thursday' WHEN '5' THEN 'Friday' WHEN '6' THEN 'Saturday' ELSE 'Unknown' END dow_name FROM work0),
site AS (SELECT fl_id, any_value(fl_name) fl_name, any_value(city) city, any_value(address) address, any_value(latitude) latitude, any_value(longitude) longitude, count(*) setup_count, coalesce(sum(monthly_contrib_hrs),0) monthly_contrib_hrs,
  max(services_per_year) anchor_spy, string_agg(DISTINCT frequency_type, ' | ' ORDER BY frequency_type) frequency_types, string_agg(DISTINCT dow_name, ' | ' ORDER BY dow_name) dow_names FROM work GROUP BY fl_id),
area AS (SELECT city, count(*) fl_count, sum(setup_count)::BIGINT setup_count, sum(monthly_contrib_hrs) total_monthly_hrs, avg(latitude) centroid_lat, avg(longitude) centroid_lon, ceil(sum(monthly_contrib_hrs)/8*2)/2 required_run_days FROM site WHERE city IS NOT NULL GROUP BY city),
rejected AS (SELECT *, CASE WHEN latitude IS NULL THEN 'no coordinates' ELSE 'outside box' END reason FROM site WHERE latitude IS NULL OR NOT (latitude BETWEEN -39.5 AND -33.9 AND longitude BETWEEN 140.5 AND 150.5)),
clean AS (SELECT * EXCLUDE (monthly_contrib_hrs), effective_duration*services_per_month mins, effective_duration*services_per_month/60 hrs, frequency_type = 'Monthly - Week Pattern' is_mwp, frequency_type LIKE '%Weekly%' is_weekly, trim(preferred_resource) IN ('','nan','None','NULL','(unassigned)') is_unassigned FROM work WHERE fl_id NOT IN (SELECT fl_id FROM rejected)),
centre AS (SELECT preferred_resource tech, sum(latitude*greatest(hrs,0.001))/sum(greatest(hrs,0.001)) c_lat, sum(longitude*greatest(hrs,0.001))/sum(greatest(hrs,0.001)) c_lon, sum(hrs) monthly_hrs, count(DISTINCT fl_id) fls FROM clean WHERE NOT is_unassigned GROUP BY 1),
near_tech AS (SELECT booking_setup_id, arg_min(tech, (d, tech)) near FROM (SELECT s.booking_setup_id, c.tech, @KM_S_C@ d FROM clean s, centre c WHERE s.is_unassigned) GROUP BY 1),
assigned AS (SELECT c.*, coalesce(near, preferred_resource) tech FROM clean c LEFT JOIN near_tech USING (booking_setup_id)),
tech_site AS (SELECT tech, fl_id, sum(hrs) monthly_hrs, count(*) setups, any_value(latitude) latitude, any_value(longitude) longitude, coalesce(max(services_per_year),1.0) anchor_freq, any_value(fl_name) fl_name, any_value(city) city FROM assigned GROUP BY 1, 2),
stub AS (SELECT *, (fl_id % 4 + 1)::INT AS week, ['Monday','Tuesday','Wednesday','Thursday','Friday'][fl_id % 5 + 1] AS day, fl_id % 11 = 0 is_outlier,
  CASE WHEN anchor_freq >= 26 THEN 5 WHEN anchor_freq >= 12 THEN 4 WHEN anchor_freq >= 4 THEN 3 WHEN anchor_freq >= 1.5 THEN 2 ELSE 1 END anchor_tier FROM tech_site),
applied AS (SELECT a.*, s.week, s.day, CASE WHEN a.is_weekly THEN 'Every '||s.day WHEN a.is_mwp THEN s.week||'-'||s.day ELSE '' END new_date_pattern FROM assigned a JOIN stub s USING (tech, fl_id)),
skel AS (SELECT t.tech, w.week::INT AS week, d.day FROM (SELECT DISTINCT tech FROM assigned) t, (SELECT unnest([1,2,3,4]) AS week) w, (SELECT unnest(['Monday','Tuesday','Wednesday','Thursday','Friday']) AS day) d),
cap AS (SELECT k.tech, k.week, k.day, (coalesce(m.v,0)+coalesce(w.v,0)/4)/60 load FROM skel k LEFT JOIN (SELECT tech, week, day, sum(mins) v FROM applied WHERE is_mwp GROUP BY ALL) m USING (tech, week, day) LEFT JOIN (SELECT tech, day, sum(mins) v FROM applied WHERE is_weekly GROUP BY ALL) w USING (tech, day)),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tech, fl_id ORDER BY km, other)::INT nn_rank FROM (SELECT a.tech, a.fl_id, b.fl_id other, @KM_A_B@ km FROM stub a JOIN stub b ON a.tech = b.tech AND a.fl_id <> b.fl_id)) WHERE nn_rank <= 7),
vote0 AS (SELECT k.tech, k.fl_id, o.week, o.day, count(*) n, min(nn_rank) f FROM knn k JOIN stub o ON o.tech = k.tech AND o.fl_id = k.other WHERE k.tech IN (SELECT tech FROM stub GROUP BY 1 HAVING count(*) > 7) GROUP BY ALL),
vote AS (SELECT s.tech, s.fl_id, s.week, s.day, arg_max(v.week, (v.n, -v.f)) top_week, arg_max(v.day, (v.n, -v.f)) top_day, max(v.n) top_votes, coalesce(max(v.n) FILTER (v.week = s.week AND v.day = s.day), 0) own_votes FROM vote0 v JOIN stub s USING (tech, fl_id) GROUP BY s.tech, s.fl_id, s.week, s.day),
dist AS (SELECT s.*, @KM_SITE_TECH@ km FROM stub s JOIN (SELECT tech, sum(latitude*greatest(monthly_hrs,0.001))/sum(greatest(monthly_hrs,0.001)) c_lat, sum(longitude*greatest(monthly_hrs,0.001))/sum(greatest(monthly_hrs,0.001)) c_lon FROM stub GROUP BY 1) c USING (tech)),
done AS (SELECT w.wo_id, w.booking_setup_id, w.tech_name, w.completed_on, s.fl_id, ((day(w.completed_on)-1)//7+1)::VARCHAR||'-'||dayname(w.completed_on) pattern FROM work_order w JOIN latest s USING (booking_setup_id) WHERE w.status IN ('Completed','Posted') AND w.completed_on >= TIMESTAMP '1999-01-01' AND w.completed_on < TIMESTAMP '2000-01-01'),
techn AS (SELECT booking_setup_id, tech_name, count(DISTINCT wo_id) n FROM done WHERE tech_name IS NOT NULL GROUP BY ALL),
products0 AS (SELECT booking_setup_id, count(*) product_count, sum(coalesce(quantity,0)*coalesce(unit_amount,0)) setup_value, sum(coalesce(quantity,0)) setup_quantity FROM product WHERE is_delete IS NULL GROUP BY 1),
branch1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY territory, division ORDER BY branch_id, branch_name) rn FROM branch_territory) WHERE rn = 1),
visits AS (SELECT DISTINCT booking_setup_id, fl_id, completed_on::DATE d, tech_name FROM done)
"""

PREFIX = (
    "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in DOMAIN.items()) + ","
    + _DERIVED.replace("@KM_S_C@", km("s.latitude", "s.longitude", "c.c_lat", "c.c_lon")).replace("@KM_A_B@", km("a.latitude", "a.longitude", "b.latitude", "b.longitude")).replace("@KM_SITE_TECH@", km("s.latitude", "s.longitude", "c.c_lat", "c.c_lon"))
)
