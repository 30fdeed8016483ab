"""Unified per-location report (M11 with J1, J7, J8, J12, P9-P14, F23, F27-F39, F48).

One DataFrame plan per batch of areas of interest:

  areas -> left joins of the landed inputs by area id (weather environment,
  soil / elevation / address payloads, vegetation proxy) + the one-row ENSO
  scalar (broadcast) -> per-domain feature columns -> model scoring
  (``PipelineModel.transform``, map-only) -> rules -> nested report struct.

Every join is keyed by the area id or is a broadcast of a bounded table (the
ENSO scalar, the per-state forest snapshot - one row per known state - and
the per-class vocabularies).  A domain whose model or inputs are missing
yields a null struct plus an entry in ``errors`` instead of failing the job.

The report never trains: it loads the last committed run of every domain.  ``refresh``
keeps reports as versions of one table.  A hash of everything an area's row depends on
(landed inputs, report month, model runs) goes with it; areas whose hash is that of the
version before are carried over and only the others are scored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import alerts as fa
from ..functions import climate as fc
from ..functions import forest as ff
from ..functions import urban as fu
from ..ml import domains
from ..operators import matching, panels, topk
from ..sources import bindings, payloads, versions
from ..sources.tables import table

REPORT_YEAR = 2025
REPORT_MONTH = 1
DOMAINS = ("crop", "drought", "weather", "forest", "urban")

#: What a domain that failed reports, in report order.
ERROR_TEXTS = {"crop": "crop_yield_predictor: model not available", "drought": "drought_models: model not available",
               "weather": "weather_models: model not available",
               "forest": "forest_models: state not found in forest history",
               "urban": "urban_models: model not available"}

# Typed stand-ins for the scoring outputs of a domain that is not run (model
# missing): the report keeps one schema and the domain becomes a null struct.
_ARR, _D, _S = "array<double>", "double", "string"
PLACEHOLDERS = {
    "crop": {"crop_probs": _ARR, "_crop_labels": "array<string>"},
    "drought": {"_spei": _D, "dcat_probs": _ARR, "dstat_pred": _D, "dstat_probs": _ARR,
                "_drought_labels": "array<string>"},
    "weather": {"_precipitation_anomaly_mm": _D, "_temperature_anomaly_c": _D, "_wind_anomaly_kmph": _D,
                "_wseason": _S, "wev_probs": _ARR, "wint_pred": _D, "_event_labels": "array<string>"},
    "forest": {"matched_state": _S, "_extrap_cover": _D, "_extrap_pct": _D, "_ndvi_used": _D, "falert_pred": _D,
               "falert_probs": _ARR, "fndvi_pred": _D, "fcover_pred": _D, "faqi_pred": _D, "fhuman_pred": _D},
    "urban": {"_u_city_urb_rate": _D, "_u_state_urb_rate": _D, "_u_urban_pop": _D, "_u_urb": _D, "upop_pred": _D,
              "uurb_pred": _D, "uinfra_pred": _D, "uupop_pred": _D, "ugrow_pred": _D},
}


def _apply(df: DataFrame, model, features: dict[str, Column], out: str, classifier: bool) -> DataFrame:
    """Score ``model`` on temporary feature columns and keep only the outputs."""
    keep = df.columns
    return _score(df.select("*", *[v.alias(k) for k, v in features.items()]), model, out, classifier, keep)


def _score(df: DataFrame, model, out: str, classifier: bool, keep: list[str] | None = None) -> DataFrame:
    """Score ``model`` on feature columns already present in ``df``."""
    keep = keep or df.columns
    scored = model.transform(df)
    cols = [F.col("prediction").alias(f"{out}_pred")]
    if classifier:
        cols.append(vector_to_array_col("probability").alias(f"{out}_probs"))
    return scored.select(*keep, *cols)


def vector_to_array_col(c: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(c)


def _vocab_idx(vocab: DataFrame, value: Column, name: str, df: DataFrame) -> DataFrame:
    v = vocab.select(F.col("value").alias(f"_{name}_v"), F.col("idx").alias(name))
    j = df.join(v, value == F.col(f"_{name}_v"), "left").drop(f"_{name}_v")
    return j.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def _labels(vocab: DataFrame, name: str) -> DataFrame:
    """Vocabulary as one row holding the label array (size = class count)."""
    return vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"])
                     .alias(name))


def report_inputs(spark: SparkSession, d: str) -> DataFrame:
    from .queries_payloads import enso_lines, location_payloads, weather_payloads
    aoi = bindings.aoi(spark, d)
    cust = table(spark, d, "customer", "c_custkey", "c_nationkey")
    nation = table(spark, d, "nation", "n_nationkey", "n_name")
    geo_state = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("aoi_id"), F.col("n_name").alias("geo_state"))
    pay = location_payloads(spark, d)
    w = weather_payloads(spark, d)
    latest_w = panels.latest_n(w, "location_id", "week", 1).select(F.col("location_id").alias("aoi_id"),
                                                                     F.col("payload").alias("weather_payload"))
    o = bindings.obs(spark, d)
    veg = o.groupBy(F.col("location_id").alias("aoi_id")).agg(
        stats_avg("precip").alias("_mp"), stats_avg("solar").alias("_mr"))
    veg = veg.select("aoi_id", fa.ndvi_proxy_a("_mp", "_mr").alias("live_ndvi"))
    lines = enso_lines(spark, d)
    mei = payloads.enso_index(lines)
    base = (aoi.join(geo_state, "aoi_id", "left").join(pay, "aoi_id", "left")
            .join(latest_w, "aoi_id", "left").join(veg, "aoi_id", "left")
            .crossJoin(F.broadcast(mei)))
    return base


def stats_avg(c: str) -> Column:
    return F.avg(c)


def hashed_inputs(inputs: DataFrame, versions_used: dict[str, str], year: int = REPORT_YEAR,
                  month: int = REPORT_MONTH) -> DataFrame:
    """``inputs`` with ``inputs_hash``, of all that an area's report depends on."""
    fixed = [F.lit(year), F.lit(month), F.lit(repr(sorted(versions_used.items())))]
    # Nulls add nothing to a hash, so every column's presence goes in as well.
    cols = [x for c in sorted(inputs.columns) for x in (F.col(c), F.col(c).isNull())]
    return inputs.withColumn("inputs_hash", F.xxhash64(*fixed, *cols))


def model_runs(spark: SparkSession, d: str, run: tuple[str, ...] = DOMAINS) -> dict[str, str]:
    """The committed model run of every domain that has one."""
    found = {k: domains.available(spark, d, k) for k in run}
    return {k: v["_run"] for k, v in found.items() if v}


def _checkpointed(df: DataFrame) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def refresh(spark: SparkSession, d: str, base: str, inputs: DataFrame | None = None, run: tuple[str, ...] = DOMAINS,
            year: int = REPORT_YEAR, month: int = REPORT_MONTH) -> DataFrame:
    """Brings the versioned report table at ``base`` up to date and returns its last version.
    ``scored_in`` names the version that scored a row: rows of earlier ones were carried over."""
    used = model_runs(spark, d, run)
    inputs = _checkpointed(hashed_inputs(report_inputs(spark, d) if inputs is None else inputs, used, year, month))
    last, version = versions.latest(spark, base), uuid.uuid4().hex
    changed, kept = inputs, None
    if last is not None:
        keys = ["aoi_id", "inputs_hash"]
        changed = inputs.join(last.select(*keys), keys, "left_anti")
        kept = last.join(inputs.select(*keys), keys, "left_semi")
    scored = unified_report(spark, d, run, year, month, changed).withColumn("scored_in", F.lit(version))
    versions.write(scored if kept is None else scored.unionByName(kept), base, version)
    return versions.latest(spark, base)


def unified_report(spark: SparkSession, d: str, run: tuple[str, ...] = DOMAINS, year: int = REPORT_YEAR,
                   month: int = REPORT_MONTH, inputs: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """The report of all areas, or of those in ``inputs``.  ``outputs`` are given model outputs by area
    (columns of ``PLACEHOLDERS``) that stand in for scoring."""
    # Cut the lineage after the input joins: a reliable checkpoint in the shared
    # folder (spark.checkpoint.dir) keeps the scoring plan small and lets a lost
    # executor's work restart from the written inputs instead of the raw scans.
    given, used = outputs is not None, {}
    if not given:
        used = {k: domains.available(spark, d, k) for k in run}
        run = tuple(k for k in run if used[k])
    if inputs is None:
        inputs = hashed_inputs(report_inputs(spark, d), {k: used[k]["_run"] for k in run if not given}, year, month)
    base = _checkpointed(inputs)
    addr = payloads.reverse_address("addr", fallback=F.col("geo_state"))
    env = payloads.weather_environment("weather_payload")
    df = base.select(
        "aoi_id", "aoi_name", "lat", "lng", "user_email", "geo_state", "mei_index", "live_ndvi",
        addr["city"].alias("city"), F.coalesce(F.col("geo_state"), addr["state"]).alias("state"),
        payloads.is_land("soil").alias("is_land"), payloads.soil_properties("soil").alias("soil"),
        payloads.elevation("elev").alias("altitude"), env.alias("env"), "inputs_hash",
        F.lit(month).alias("month"), F.lit(year).alias("year"))
    a = "env.aggregate."
    if given:
        absent = [F.lit(None).cast(t).alias(c) for dom in DOMAINS for c, t in PLACEHOLDERS[dom].items() if c not in outputs.columns]
        return _assemble(df.join(outputs, "aoi_id", "left").select("*", *absent), run)

    # ---- crop (M4 scoring, T2) -------------------------------------------------
    if "crop" in run:
        cfit = used["crop"]["crop_yield_predictor"]["model"]
        enc = used["crop"]["_encoders"]
        season = fc.crop_season(F.col("month"))
        df = df.withColumn("_crop_season", season)
        df = _vocab_idx(matching.vocab_of(enc, "state"), F.col("state"), "state_enc", df)
        df = _vocab_idx(matching.vocab_of(enc, "season"), F.col("_crop_season"), "season_enc", df)
        df = _vocab_idx(matching.vocab_of(enc, "soil_type"), F.lit("Neutral"), "soil_type_enc", df)
        df = _vocab_idx(matching.vocab_of(enc, "irrigation"), F.lit("Rainfed"), "irrigation_enc", df)
        df = _vocab_idx(matching.vocab_of(enc, "soil_texture"), F.lit("Loamy"), "soil_texture_enc", df)
        # fixed values: the reference's defaults where nothing is measured
        feats = {"n": F.lit(68.0), "p": F.lit(53.0), "k": F.lit(78.0), "fertilizer_kg": F.lit(120.0),
                 "pesticide_kg": F.lit(10.0),
                 "rainfall": F.col(a + "rainfall_annualized"), "humidity": F.col(a + "humidity"),
                 "temperature": F.col(a + "avg_temp"), "sunshine_hours": F.col(a + "sunshine_hours"),
                 "wind_kmh": F.col(a + "wind_kmh"), "ph": F.col("soil.ph"), "soil_moisture": F.col("soil.soil_moisture"),
                 "organic_carbon": F.col("soil.organic_carbon"), "altitude_m": F.col("altitude")}
        df = _apply(df, cfit, {k: v.cast("double") for k, v in feats.items()}, "crop", classifier=True)
        df = df.crossJoin(F.broadcast(_labels(matching.vocab_of(enc, "crop"), "_crop_labels")))
        df = df.drop("state_enc", "season_enc", "soil_type_enc", "irrigation_enc", "soil_texture_enc")

    # ---- drought (M6 scoring, F9, F17-F19) --------------------------------------
    if "drought" in run:
        dfit = used["drought"]
        enc = fc.cyclic_encode("lat", "lng", "month", digits=6)
        spei = fc.estimate_spei(F.col(a + "precip_week"), F.col(a + "avg_temp"), F.col(a + "humidity"), digits=4)
        df = df.withColumn("_spei", spei)
        dfe = fc.drought_features(F.col(a + "max_temp"), F.col(a + "min_temp"), F.col(a + "humidity"),
                                  F.col(a + "precip_week"), F.col(a + "solar"), F.col(a + "wind_ms"))
        feats = {"humidity": F.col(a + "humidity"), "max_temp": F.col(a + "max_temp"), "min_temp": F.col(a + "min_temp"),
                 "wind_ms": F.col(a + "wind_ms"), "avg_temp": F.col(a + "avg_temp"), "solar": F.col(a + "solar"),
                 "precip_week": F.col(a + "precip_week"), "spei": F.col("_spei"),
                 **{k: v for k, v in enc.items()}, "season": fc.season_code("month"),
                 "lon": F.col("lng"), **dfe, "wind_bin": F.col(a + "wind_bin")}
        # lat and month are already columns of the frame
        feats = {k: v for k, v in feats.items() if k in domains.DROUGHT_FEATURES and k not in ("lat", "month")}
        # features are materialized once and shared by both models
        base_cols = df.columns
        df = df.select("*", *[v.alias(k) for k, v in feats.items()])
        df = _score(df, dfit["drought_category_model"]["model"], "dcat", True)
        df = _score(df, dfit["drought_status_model"]["model"], "dstat", True)
        df = df.select(*base_cols, "dcat_pred", "dcat_probs", "dstat_pred", "dstat_probs")
        dvocab = matching.vocab_of(used["drought"]["_encoders"], "category")
        df = df.crossJoin(F.broadcast(_labels(dvocab, "_drought_labels")))

    # ---- weather (M5 scoring, F11, F36, F37, F20) ----------------------------------
    if "weather" in run:
        wfit = used["weather"]
        wenc = used["weather"]["_encoders"]
        an = fc.anomalies(F.col(a + "avg_temp"), F.col(a + "precip_week"), F.col(a + "wind_kmh"))
        df = df.select("*", *[v.alias("_" + k) for k, v in an.items()], fc.weather_season("month").alias("_wseason"))
        df = _vocab_idx(matching.vocab_of(wenc, "state"), F.col("state"), "state_enc", df)
        df = _vocab_idx(matching.vocab_of(wenc, "season"), F.col("_wseason"), "season_enc", df)
        st = F.col("state")
        feats = {"is_coastal": st.isin(dims.COASTAL_STATES).cast("int"), "is_hilly": st.isin(dims.HILLY_STATES).cast("int"),
                 "is_dry": st.isin(dims.DRY_STATES).cast("int"),
                 "precipitation_anomaly_mm": F.col("_precipitation_anomaly_mm"),
                 "temperature_anomaly_c": F.col("_temperature_anomaly_c"),
                 "wind_anomaly_kmph": F.col("_wind_anomaly_kmph"), "duration_days": F.lit(5)}
        # month, mei_index, state_enc and season_enc are already columns of the frame
        base_cols = df.columns
        df = df.select("*", *[v.alias(k) for k, v in feats.items()])
        df = _score(df, wfit["weather_event_model"]["model"], "wev", True)
        df = _score(df, wfit["weather_intensity_model"]["model"], "wint", False)
        df = df.select(*base_cols, "wev_pred", "wev_probs", "wint_pred")
        df = df.drop("state_enc", "season_enc")
        evocab = matching.vocab_of(wenc, "event_type")
        df = df.crossJoin(F.broadcast(_labels(evocab, "_event_labels")))

    # ---- forest (J1, F27, M7 scoring, F34) ------------------------------------------
    if "forest" in run:
        ffit = used["forest"]
        fdata = panels.forest_features(bindings.state_panel(spark, d))
        snap_cols = [c for c in domains.FOREST_FEATURES if c not in ("state_enc",)]
        snap = panels.latest_non_null(fdata.select("state", *[c for c in snap_cols]), "state", "year")
        snap = snap.select(F.col("state").alias("_fkey"), *[F.col(c).alias("h_" + c) for c in snap_cols])
        # The name is resolved against the encoder's states (one row a state), then J1
        known = sorted(r["value"] for r in matching.vocab_of(used["forest"]["_encoders"], "state").collect())
        df = matching.with_state_match(df, "state", known).drop("match_method")
        df = df.join(snap, F.col("matched_state") == F.col("_fkey"), "left").drop("_fkey")
        df = _vocab_idx(matching.vocab_of(used["forest"]["_encoders"], "state"), F.col("matched_state"),
                        "state_enc", df)
        ex = ff.extrapolate_forest("h_forest_cover", "h_forest_pct", "h_forest_change_yoy", "h_forest_pct_change_yoy",
                                   "h_year", F.col("year"), "h_ndvi", F.col("live_ndvi"), "h_ndvi_change_yoy")
        df = df.select("*", *[v.alias("_" + k) for k, v in ex.items()])
        z = lambda c: F.coalesce(F.nullif(F.col("h_" + c), F.lit(0.0)), F.lit(0.0))
        feats = {c: z(c) for c in snap_cols}
        feats.update({"forest_cover": F.col("_extrap_cover"), "forest_pct": F.col("_extrap_pct"),
                      "ndvi": F.col("_ndvi_used"), "ndvi_change_yoy": F.col("_ndvi_change"),
                      "forest_cover_3yr_avg": F.coalesce(F.nullif(F.col("h_forest_cover_3yr_avg"), F.lit(0.0)), F.col("_extrap_cover")),
                      "ndvi_3yr_avg": F.coalesce(F.nullif(F.col("h_ndvi_3yr_avg"), F.lit(0.0)), F.col("_ndvi_used")),
                      "forest_pct_3yr_avg": F.coalesce(F.nullif(F.col("h_forest_pct_3yr_avg"), F.lit(0.0)), F.col("_extrap_pct")),
                      "forest_cover_5yr_avg": F.coalesce(F.nullif(F.col("h_forest_cover_5yr_avg"), F.lit(0.0)), F.col("_extrap_cover")),
                      "ndvi_5yr_avg": F.coalesce(F.nullif(F.col("h_ndvi_5yr_avg"), F.lit(0.0)), F.col("_ndvi_used"))})
        feats = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in feats.items() if k not in ("year", "state_enc")}
        # the model's "year" feature is the report year (already a column)
        df = df.withColumnRenamed("year", "_y").withColumn("year", F.col("_y").cast("double"))
        base_cols = df.columns
        df = df.select("*", *[v.alias(k) for k, v in feats.items()])
        outs = []
        for name, out, cls in (("forest_alert_model", "falert", True), ("forest_ndvi_model", "fndvi", False),
                               ("forest_cover_model", "fcover", False), ("forest_aqi_model", "faqi", False),
                               ("forest_human_model", "fhuman", False)):
            df = _score(df, ffit[name]["model"], out, cls)
            outs += [f"{out}_pred"] + ([f"{out}_probs"] if cls else [])
        df = df.select(*base_cols, *outs)
        df = df.drop("year").withColumnRenamed("_y", "year").drop("state_enc")

    # ---- urban (F28, J7, F29, F31, M8 scoring, F32, F33) ----------------------------
    if "urban" in run:
        ufit = used["urban"]
        exd = fu.extrapolate_demographics(F.col("year"))
        rates = matching.effective_urb_rate("city", "state", exd["urb_rate"])
        df = df.select("*", *[v.alias("_u_" + k) for k, v in rates.items()])
        exd = fu.extrapolate_demographics(F.col("year"))
        feats = fu.urban_feature_row(F.col("year"), exd, F.col("_u_effective_urb_rate"))
        feats = {k: v.cast("double") for k, v in feats.items()}
        df = df.select("*", feats["urban_pop_m"].alias("_u_urban_pop"), feats["urbanization_rate"].alias("_u_urb"))
        base_cols = df.columns
        df = df.select("*", *[v.alias(k) for k, v in feats.items()])
        for name, out in (("urban_pop_model", "upop"), ("urban_urb_model", "uurb"), ("urban_infra_model", "uinfra"),
                          ("urban_upop_model", "uupop"), ("urban_grow_model", "ugrow")):
            df = _score(df, ufit[name]["model"], out, False)
        df = df.select(*base_cols, "upop_pred", "uurb_pred", "uinfra_pred", "uupop_pred", "ugrow_pred")

    for dom in DOMAINS:
        if dom not in run:
            df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in PLACEHOLDERS[dom].items()])
    return _assemble(df, run)


def _assemble(df: DataFrame, run) -> DataFrame:
    a, cur = "env.aggregate.", "env.current."
    land = F.col("is_land")
    top5 = topk.top_k(F.col("crop_probs"), F.col("_crop_labels"), 5)
    top5 = F.transform(top5, lambda s: F.struct(s["label"].alias("crop"), F.bround(s["p"] * 100, 1).alias("confidence")))
    crop = F.struct(F.element_at(top5, 1)["crop"].alias("recommended_crop"),
                    F.element_at(top5, 1)["confidence"].alias("confidence"), top5.alias("top_predictions"),
                    fc.crop_season("month").alias("season"), F.col("state").alias("state"))
    top3 = topk.top_k(F.col("dcat_probs"), F.col("_drought_labels"), 3)
    top3 = F.transform(top3, lambda s: F.struct(s["label"].alias("category"), F.bround(s["p"] * 100, 1).alias("confidence")))
    active = F.col("dstat_pred") >= 1
    primary = F.element_at(top3, 1)["category"]
    drought = F.struct(primary.alias("primary_category"), top3.alias("top_categories"),
                       F.col("_spei").alias("estimated_spei"), fa.drought_alert(primary, active).alias("alert_level"),
                       active.alias("drought_active"), F.col("dstat_pred").cast("int").alias("drought_status_code"),
                       F.bround(topk.confidence_of("dstat_probs", F.col("dstat_pred").cast("int")), 1).alias("status_confidence"))
    # boosts are keyed by class name, so the factors follow this model's label order
    adj = topk.boost_event_probs("wev_probs", "state", "_wseason", "_precipitation_anomaly_mm", "_wind_anomaly_kmph",
                                 "_temperature_anomaly_c", F.col("_event_labels"))
    top3 = topk.top_k(adj, F.col("_event_labels"), 3)
    top3 = F.transform(top3, lambda s: F.struct(s["label"].alias("event"), F.bround(s["p"] * 100, 1).alias("confidence")))
    intensity = F.bround(fa.clip("wint_pred", 1.0, 10.0), 1)
    weather = F.struct(F.element_at(top3, 1)["event"].alias("primary_event"),
                       F.element_at(top3, 1)["confidence"].alias("confidence"), top3.alias("top_events"),
                       F.col("_wseason").alias("season"), intensity.alias("intensity"),
                       fa.intensity_level(intensity).alias("intensity_label"), F.col("mei_index").alias("mei_index"))
    code = F.col("falert_pred").cast("int")
    effects = ff.forest_effects(code, F.bround("faqi_pred", 1), F.bround("fhuman_pred", 1), F.col("_extrap_pct"),
                                F.col("_ndvi_used"), F.bround("fcover_pred", 1), F.col("_extrap_cover"))
    forest = F.when(F.col("matched_state").isNotNull(), F.struct(
        F.col("matched_state").alias("matched_state"), code.alias("deforestation_alert_code"),
        matching.alert_label(code).alias("deforestation_alert_label"),
        F.bround(topk.confidence_of("falert_probs", code), 1).alias("confidence"),
        F.bround("fndvi_pred", 3).alias("future_ndvi"), F.bround("fcover_pred", 1).alias("future_forest_cover_sqkm"),
        F.bround("faqi_pred", 1).alias("aqi_impact_score"), F.bround("fhuman_pred", 1).alias("human_impact_score"),
        effects.alias("effects_report")))
    needs = fu.infrastructure_needs(F.col("uinfra_pred"), F.col("_u_urban_pop"), F.col("uupop_pred"),
                                    F.col("_u_urb"), F.col("uurb_pred"))
    urban = F.struct(F.bround("upop_pred", 2).alias("future_population_millions"),
                     F.bround("uurb_pred", 2).alias("future_urbanization_rate"),
                     F.bround("uupop_pred", 2).alias("future_urban_population_millions"),
                     F.bround("uinfra_pred", 2).alias("future_infrastructure_pressure_score"),
                     F.bround("ugrow_pred", 4).alias("future_growth_rate"), needs.alias("infrastructure_needs"),
                     fu.urbanization_effects(F.col("_u_urb"), F.col("uurb_pred"), F.col("uinfra_pred")).alias("effects_report"),
                     F.struct(F.col("_u_city_urb_rate").alias("city_urb_rate"),
                              F.col("_u_state_urb_rate").alias("state_urb_rate")).alias("location_specific_rates"))

    names = ["crop", "drought", "weather", "forest", "urban"]
    parts = dict(zip(names, [crop, drought, weather, forest, urban]))
    # a domain that did not run is a typed null struct; water rows get no domains
    out = df.select("*", *[F.when(land & F.lit(k in run), v).alias(f"_d_{k}") for k, v in parts.items()])
    dcol = {k: F.col(f"_d_{k}") for k in names}
    model_groups = {"crop": ["crop_yield_predictor"], "drought": ["drought_category_model", "drought_status_model"],
                    "weather": ["weather_event_model", "weather_intensity_model"],
                    "forest": ["forest_alert_model", "forest_ndvi_model", "forest_cover_model", "forest_aqi_model",
                               "forest_human_model"],
                    "urban": ["urban_pop_model", "urban_urb_model", "urban_infra_model", "urban_upop_model",
                              "urban_grow_model"]}
    errors = F.array_compact(F.array(*[F.when(land & dcol[k].isNull(), F.lit(ERROR_TEXTS[k])) for k in names]))
    models_run = F.flatten(F.array(*[F.when(dcol[k].isNotNull(), F.array(*[F.lit(m) for m in model_groups[k]]))
                                     .otherwise(F.array().cast("array<string>")) for k in names]))
    ndvi = F.col("live_ndvi")
    idx = fa.indices(F.col(cur + "precipitation"), ndvi, F.col(cur + "temperature"), F.col(cur + "windspeed"))
    base_level = fa.level_from_points(fa.alert_points(F.lit(None), F.col(cur + "temperature"), F.col(cur + "windspeed"),
                                                      F.col(cur + "precipitation")))
    level = fa.ensemble_level(base_level, dcol["drought"]["alert_level"], dcol["weather"]["intensity_label"],
                              dcol["forest"]["deforestation_alert_code"],
                              dcol["urban"]["future_infrastructure_pressure_score"])
    level = F.when(land, level).otherwise(F.lit("GREEN"))
    signals = F.when(land, F.array_compact(F.array(
        F.when(dcol["crop"].isNotNull(), F.concat(F.lit("crop="), dcol["crop"]["recommended_crop"])),
        F.when(dcol["drought"].isNotNull(), F.concat(F.lit("drought="), dcol["drought"]["primary_category"])),
        F.when(dcol["weather"].isNotNull(), F.concat(F.lit("weather="), dcol["weather"]["primary_event"])),
        F.when(dcol["forest"].isNotNull(), F.concat(F.lit("forest="), dcol["forest"]["deforestation_alert_label"])),
        F.when(dcol["urban"].isNotNull(), F.concat(F.lit("urban_infra="),
                                                   dcol["urban"]["future_infrastructure_pressure_score"].cast("string")))))
    ).otherwise(F.array(F.lit("Location identified as water or unrecognized territory.")))
    summary = _summary(dcol)
    preds = predictions_struct(dcol)
    return out.select(
        "aoi_id", F.col("aoi_name").alias("location"), F.struct(F.col("lat"), F.col("lng").alias("lon")).alias("coordinates"),
        "state", (~land).alias("is_water"), "user_email",
        F.struct(F.col(cur + "temperature").alias("temperature"), F.col(cur + "windspeed").alias("wind_speed"),
                 F.col(cur + "precipitation").alias("precipitation")).alias("inputs"),
        F.when(land, F.struct(ndvi.alias("ndvi"), *[F.bround(v, 3).alias(k) if k != "risk_level" else F.bround(v, 2).alias(k)
                                                  for k, v in idx.items()])).alias("indices"),
        domains_struct(preds).alias("domains"),
        preds.alias("predictions"),
        F.struct(F.struct(dcol["forest"]["effects_report"].alias("forest"),
                          dcol["urban"]["effects_report"].alias("urban")).alias("effects_report"),
                 dcol["urban"]["infrastructure_needs"].alias("infrastructure_needs")).alias("reports"),
        F.struct(level.alias("overall_alert_level"), signals.alias("signals")).alias("ensemble"),
        F.struct(F.lit(0).alias("manual_input_required"), models_run.alias("models_run")).alias("automation"),
        F.col("env.current").alias("weather_snapshot"),
        summary.alias("summary"),
        errors.alias("errors"), "inputs_hash")


def _sub(domain: Column, **fields: str) -> Column:
    """A per-model entry: selected fields of a domain struct, null when the domain failed."""
    return F.when(domain.isNotNull(), F.struct(*[domain[src].alias(dst) for dst, src in fields.items()]))


def predictions_struct(d: dict[str, Column]) -> Column:
    """One entry per model, named as the reference's model registry."""
    dr, we, fo, ur = d["drought"], d["weather"], d["forest"], d["urban"]
    return F.struct(
        d["crop"].alias("crop_yield_predictor"),
        _sub(dr, primary_category="primary_category", top_categories="top_categories",
             estimated_spei="estimated_spei", alert_level="alert_level").alias("drought_category_model"),
        _sub(dr, drought_active="drought_active", drought_status_code="drought_status_code",
             confidence="status_confidence").alias("drought_status_model"),
        _sub(we, primary_event="primary_event", confidence="confidence", top_events="top_events",
             season="season").alias("weather_event_model"),
        _sub(we, intensity="intensity", label="intensity_label", mei_index="mei_index").alias("weather_intensity_model"),
        _sub(fo, deforestation_alert_code="deforestation_alert_code",
             deforestation_alert_label="deforestation_alert_label", confidence="confidence").alias("forest_alert_model"),
        _sub(fo, future_ndvi="future_ndvi").alias("forest_ndvi_model"),
        _sub(fo, future_forest_cover_sqkm="future_forest_cover_sqkm").alias("forest_cover_model"),
        _sub(fo, aqi_impact_score="aqi_impact_score").alias("forest_aqi_model"),
        _sub(fo, human_impact_score="human_impact_score", effects_report="effects_report").alias("forest_human_model"),
        _sub(ur, future_population_millions="future_population_millions").alias("urban_pop_model"),
        _sub(ur, future_urbanization_rate="future_urbanization_rate").alias("urban_urb_model"),
        _sub(ur, future_infrastructure_pressure_score="future_infrastructure_pressure_score",
             infrastructure_needs="infrastructure_needs").alias("urban_infra_model"),
        _sub(ur, future_urban_population_millions="future_urban_population_millions").alias("urban_upop_model"),
        _sub(ur, future_growth_rate="future_growth_rate").alias("urban_grow_model"))


def domains_struct(p: Column) -> Column:
    """The five domains, each grouping its models' entries."""
    return F.struct(
        F.struct(p["crop_yield_predictor"].alias("best_crop")).alias("crop_intelligence"),
        F.struct(p["drought_category_model"].alias("category"), p["drought_status_model"].alias("status"))
        .alias("drought_monitoring"),
        F.struct(p["weather_event_model"].alias("event"), p["weather_intensity_model"].alias("intensity"))
        .alias("weather_disaster"),
        F.struct(p["forest_alert_model"].alias("alert"), p["forest_ndvi_model"].alias("future_ndvi"),
                 p["forest_cover_model"].alias("future_cover"), p["forest_aqi_model"].alias("aqi_impact"),
                 p["forest_human_model"].alias("human_impact")).alias("forest_health"),
        F.struct(p["urban_pop_model"].alias("population"), p["urban_urb_model"].alias("urbanization"),
                 p["urban_infra_model"].alias("infrastructure"), p["urban_upop_model"].alias("urban_population"),
                 p["urban_grow_model"].alias("growth")).alias("urban_growth"))


def _summary(d: dict[str, Column]) -> Column:
    """sentence from the parts that succeeded, else a fallback."""
    s = F.concat_ws(" ",
                    F.when(d["crop"].isNotNull(), F.concat(F.lit("Crop recommendation is "), d["crop"]["recommended_crop"], F.lit("."))),
                    F.when(d["drought"].isNotNull(), F.concat(
                        F.lit("Drought outlook is "), d["drought"]["primary_category"], F.lit(" and drought is "),
                        F.when(d["drought"]["drought_active"], F.lit("active")).otherwise(F.lit("not active")), F.lit("."))),
                    F.when(d["forest"].isNotNull(), F.concat(F.lit("Forest outlook is "),
                                                             d["forest"]["deforestation_alert_label"], F.lit("."))),
                    F.when(d["urban"].isNotNull(), F.concat(
                        F.lit("Urban infrastructure pressure is "),
                        d["urban"]["future_infrastructure_pressure_score"].cast("string"), F.lit("."))))
    return F.when(s == "", F.lit("AOI analyzed with limited ML coverage.")).otherwise(s)


# F48 ------------------------------------------------------------------------------
def report_lines(report: DataFrame) -> DataFrame:
    """Chat answer lines from a report (only parts that succeeded)."""
    p = F.col("predictions")
    text = lambda c: c.cast("string")

    def line(model: str, *parts) -> Column:
        """One line of a model's entry; none if the model failed."""
        return F.when(p[model].isNotNull(), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))

    crop, status, wev = p["crop_yield_predictor"], p["drought_status_model"], p["weather_event_model"]
    strength, alert = p["weather_intensity_model"], p["forest_alert_model"]
    lines = F.array_compact(F.array(
        F.concat(F.lit("Alert: "), F.col("ensemble.overall_alert_level")),
        line("crop_yield_predictor", "Crop model: ", crop["recommended_crop"], " (", text(crop["confidence"]), "%)"),
        line("drought_category_model", "Drought category model: ", p["drought_category_model"]["primary_category"]),
        line("drought_category_model", "Drought status model: ",
             F.when(status["drought_active"], F.lit("active")).otherwise(F.lit("inactive"))),
        line("weather_event_model", "Weather event model: ", wev["primary_event"], " (", text(wev["confidence"]), "%)"),
        line("weather_intensity_model", "Weather intensity model: ", text(strength["intensity"]), "/10 (", strength["label"], ")"),
        line("forest_alert_model", "Forest alert model: ", alert["deforestation_alert_label"], " (", text(alert["confidence"]), "%)"),
        line("forest_ndvi_model", "Forest NDVI model: future NDVI ", text(p["forest_ndvi_model"]["future_ndvi"])),
        line("urban_pop_model", "Urban population model: ", text(p["urban_pop_model"]["future_population_millions"]), "M"),
        line("urban_urb_model", "Urbanization model: ", text(p["urban_urb_model"]["future_urbanization_rate"]), "%"),
        line("urban_infra_model", "Urban infra model: score ",
             text(p["urban_infra_model"]["future_infrastructure_pressure_score"])),
        line("urban_grow_model", "Urban growth model: ", text(p["urban_grow_model"]["future_growth_rate"]), "%"),
        F.when(F.size("errors") > 0, F.concat(F.lit("Errors: "), F.array_join("errors", "; ")))))
    return report.select("aoi_id", F.array_join(lines, "\n").alias("answer"))
