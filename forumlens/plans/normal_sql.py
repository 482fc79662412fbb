"""Oracle SQL of the normalised counts and times."""

NUM_ORACLE = """
CASE WHEN number_text IS NULL THEN NULL
     WHEN trim(translate(number_text, '０１２３４５６７８９．，', '0123456789.,')) = '' THEN 0
     WHEN regexp_extract(trim(translate(number_text, '０１２３４５６７８９．，', '0123456789.,')),
          '^([0-9][0-9,]*([.][0-9]+)?)(万|千)?(件|個|円|人|回|分|時間)?$', 1) = '' THEN NULL
     ELSE (SELECT CASE WHEN strpos(num, '.') > 0 AND mul = '' THEN NULL
                       ELSE CAST(floor(TRY_CAST(replace(num, ',', '') AS DECIMAL(24, 6))
                            * CASE mul WHEN '万' THEN 10000 WHEN '千' THEN 1000 ELSE 1 END) AS BIGINT) END
           FROM (SELECT regexp_extract(tt, '^([0-9][0-9,]*([.][0-9]+)?)(万|千)?(件|個|円|人|回|分|時間)?$', 1) AS num,
                        regexp_extract(tt, '^([0-9][0-9,]*([.][0-9]+)?)(万|千)?(件|個|円|人|回|分|時間)?$', 3) AS mul
                 FROM (SELECT trim(translate(number_text, '０１２３４５６７８９．，', '0123456789.,')) AS tt) s1) s2)
END"""

TIME_ORACLE = """
WITH p AS (
  SELECT id, time_text, base_time, split_part(time_text, '(', 1) AS day,
         split_part(trim(split_part(time_text, ')', -1)), ' ', 1) AS clock,
         split_part(time_text, '前', 1) AS body
  FROM time_text_v),
q AS (
  SELECT *, len(day) - len(replace(day, '/', '')) AS slashes,
         TRY_CAST(replace(body, '分', '') AS INTEGER) AS n_minutes,
         TRY_CAST(replace(body, '時間', '') AS INTEGER) AS n_hours,
         TRY_CAST(replace(body, '日', '') AS INTEGER) AS n_days,
         try_strptime(day || ' ' || clock, '%Y/%m/%d %H:%M') AS full_date,
         try_strptime(year(base_time) || '/' || day || ' ' || clock, '%Y/%m/%d %H:%M') AS same_year,
         try_strptime((year(base_time) - 1) || '/' || day || ' ' || clock, '%Y/%m/%d %H:%M') AS prev_year
  FROM p)
SELECT id, time_text, date_trunc('minute',
  CASE WHEN time_text = 'たった今' THEN base_time
       WHEN strpos(time_text, '前') > 0 THEN
            CASE WHEN suffix(body, '分') AND n_minutes >= 0 THEN base_time - to_minutes(n_minutes)
                 WHEN suffix(body, '時間') AND n_hours >= 0 THEN base_time - to_hours(n_hours)
                 WHEN suffix(body, '日') AND n_days >= 0 THEN base_time - to_days(n_days) END
       WHEN strpos(time_text, '(') = 0 OR strpos(time_text, ')') = 0 THEN NULL
       WHEN slashes = 2 THEN full_date
       WHEN slashes = 1 AND same_year > base_time THEN prev_year
       WHEN slashes = 1 THEN same_year END) AS normalized_time
FROM q"""
