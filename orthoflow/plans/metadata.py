"""Names, metadata texts and parameter files."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.functions import templates as T
from orthoflow.plans.fixtures import table
from orthoflow.plans.registry import query
from orthoflow.sources import scenes as S

NAMES = """names AS (SELECT DISTINCT 'p_' || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '1034251_x_' || strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER), '%Y%m%d') || '1030181' AS name FROM orders)"""


def names(spark, sf_dir):
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_custkey") % 90).cast("int"))
    text = lambda d: F.date_format(d, "yyyyMMdd")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p_"), text(day), F.lit("1034251_x_"), text(later), F.lit("1030181")).alias("name")
    ).distinct()


@query(f"""WITH {NAMES} SELECT name, CAST(strptime(regexp_extract(name, '(20[0-9]{{6}})[0-9]{{7}}.*(20[0-9]{{6}})[0-9]{{7}}', 1), '%Y%m%d') AS DATE)::VARCHAR AS date1,
CAST(strptime(regexp_extract(name, '(20[0-9]{{6}})[0-9]{{7}}.*(20[0-9]{{6}})[0-9]{{7}}', 2), '%Y%m%d') AS DATE)::VARCHAR AS date2 FROM names
WHERE regexp_matches(name, '(20[0-9]{{6}})[0-9]{{7}}.*(20[0-9]{{6}})[0-9]{{7}}')""")
def extract_dates(spark, sf_dir):
    found = names(spark, sf_dir).withColumn("d", R.two_dates(F.col("name"))).where("d is not null")
    return found.select("name", F.col("d.date1").cast("string").alias("date1"), F.col("d.date2").cast("string").alias("date2"))


@query("""SELECT 'LC8' || p_partkey AS path, strftime(DATE '2015-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS date, '10:0' || p_partkey % 10 || ':00Z' AS time,
'B8_' || p_partkey || '.TIF' AS match_band FROM part""")
def parse_metadata(spark, sf_dir):
    """Metadata lines are made of parts, then parsed again."""
    key = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (key % 1000).cast("int")), "yyyy-MM-dd")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = [q('    DATE_ACQUIRED = ', day), q('    SCENE_CENTER_TIME = "10:0', key % 10, ':00Z"'), q('    FILE_NAME_BAND_QUALITY = "X_BQA.TIF"')]
    lines += [q(f'    FILE_NAME_BAND_{b} = "B{b}_', key, '.TIF"') for b in range(1, 10)]
    texts = table(spark, sf_dir, "part").select(q("LC8", key).alias("path"), F.explode(F.array(*lines)).alias("value"))
    found = S.landsat_scenes(texts)
    return found.select("path", F.col("date").cast("string").alias("date"), "time", "match_band")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x_B03.jp2,x_B04.jp2' ELSE 'x_B04.jp2' END AS bands FROM part""")
def band_subset(spark, sf_dir):
    all_bands = F.array(*[F.lit(f"x_{b}.jp2") for b in ("B02", "B03", "B04", "B08")])
    some = F.when(F.col("p_size") % 2 == 0, all_bands).otherwise(F.array(F.lit("x_B04.jp2"), F.lit("x_B11.jp2")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.select_bands(some, ["B03", "B04"]), ",").alias("bands"))


# fixed values: the folders of each mode, and below all texts of the parameter file and the mask file
_LINES = """CASE p_size % 3 WHEN 0 THEN '<Symb> DirMEC=MEC/ </Symb>
<Symb> Pyr=Pyram/ </Symb>' ELSE '<Symb> Dir=MEC/ </Symb>
<Symb> Pyr=PyramSat/ </Symb>' END"""


@query(f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'coregis' WHEN 1 THEN 'displacement' ELSE 'bathy' END AS mode, '<ParamMICMAC>
<DicoLoc>
<Symb> Im1=a' || p_partkey || '.tif </Symb>
<Symb> Im2=b' || p_partkey || '.tif </Symb>
<Symb> Masq=$m' || p_partkey || '.stop </Symb>
' || {_LINES} || '
<Symb> Inc=' || p_size || ' </Symb>
<Symb> Pas=0.2 </Symb>
<Symb> Teta0=0 </Symb>
<Symb> UseMasq=true </Symb>
<Symb> UseTeta=false </Symb>
<Symb> RegulBase=' || CASE p_size % 3 WHEN 0 THEN '0.3' WHEN 1 THEN '0.2' ELSE '0.4' END || ' </Symb>
<Symb> UseDequant=true </Symb>
<Symb> SzW=' || p_size % 7 || ' </Symb>
<Symb> CorrelMin=' || CASE p_size % 3 WHEN 1 THEN '0.2' ELSE '0.5' END || ' </Symb>
<Symb> GammaCorrel=2 </Symb>
<Symb> PdsF=0.1 </Symb>
<Symb> NbDir=7 </Symb>
' || (SELECT string_agg('<eSymb> P' || k || '= / ${{PdsF}} +   ${{PdsF}} / ' || k || ' ${{NbDir}} </eSymb>', chr(10) ORDER BY k) FROM range(8) t(k)) || '
<Symb> VPds=[${{P0}},${{P1}},${{P2}},${{P3}},${{P4}},${{P5}},${{P6}},${{P7}},${{P6}},${{P7}},${{P4}},${{P3}},${{P2}},${{P1}}] </Symb>
<eSymb> NbDirTot=* 2 ${{NbDir}} </eSymb>
<eSymb> Regul=* ${{RegulBase}}  ? ${{UseTeta}} 3 1 </eSymb>
' || CASE p_size % 3 WHEN 0 THEN '<Symb> SsResolOpt=4 </Symb>
<eSymb> SsResolOptInterm1=* 4 ${{SsResolOpt}} </eSymb>
<eSymb> SsResolOptInterm2=* 2 ${{SsResolOpt}} </eSymb>
<Symb> Px1Moy=0 </Symb>
<Symb> Px2Moy=0 </Symb>
<Symb> ZoomInit=1 </Symb>
<eSymb> WithZ4= SupEq ${{ZoomInit}} 4 </eSymb>
<eSymb> WithZ2= SupEq ${{ZoomInit}} 2 </eSymb>
' ELSE '' END || '</DicoLoc>
</ParamMICMAC>' AS params FROM part""")
def param_template(spark, sf_dir):
    """Parameter texts of all modes with their images, mask, window and search area."""
    mode = F.when(F.col("p_size") % 3 == 0, "coregis").when(F.col("p_size") % 3 == 1, "displacement").otherwise("bathy")
    named = lambda a, b: F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b))
    text = T.parameter_file(mode, window=F.col("p_size") % 7, search=F.col("p_size"))
    text = T.set_inputs(text, named("a", ".tif"), named("b", ".tif"), named("$m", ".stop"))
    return table(spark, sf_dir, "part").select("p_partkey", mode.alias("mode"), text.alias("params"))


@query("""SELECT p_partkey, '<?xml version="1.0" ?>
<FileOriMnt>
     <NameFileMnt>./' || p_name || '</NameFileMnt>
     <NombrePixels>' || p_size * 100 || ' ' || p_size * 50 || '</NombrePixels>
     <OriginePlani>0 0</OriginePlani>
     <ResolutionPlani>1 1</ResolutionPlani>
     <OrigineAlti>0</OrigineAlti>
     <ResolutionAlti>1</ResolutionAlti>
     <Geometrie>eGeomMNTFaisceauIm1PrCh_Px1D</Geometrie>
</FileOriMnt>
' AS xml FROM part""")
def mask_xml(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.mask_file(F.col("p_name"), size * 100, size * 50).alias("xml"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def complete_outputs(spark, sf_dir):
    return S.complete(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT o_custkey, min(CAST(o_orderdate AS DATE))::VARCHAR AS first, CAST(datediff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS INTEGER) AS days FROM orders GROUP BY o_custkey")
def durations(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day).cast("string").alias("first"), F.datediff(F.max(day), F.min(day)).alias("days"))


@query("SELECT DISTINCT p_size, CAST(ceil(p_size * 0.8::DOUBLE) AS BIGINT) + 2 AS area FROM part")
def search_area(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", R.search_area(F.col("p_size").cast("double")).alias("area")).distinct()


@query("""SELECT event_id, round(exp(-(((value - 36) / 28.0) ** 2) / 2) / (28.0 * sqrt(2 * pi())), 10) AS density FROM events""")
def normal_density(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(R.normal_density(F.col("value"), F.lit(36.0), F.lit(28.0)), 10).alias("density"))
