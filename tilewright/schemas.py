"""The tables of the engine, each with a fixed schema."""

from __future__ import annotations

CELLS = "raster_id string, band int, r bigint, c bigint, value double"
TRANSFORM = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
RASTERS = f"raster_id string, bands int, height bigint, width bigint, transform {TRANSFORM}, crs string, nodata double"
COVERAGE = "valid_pixels:bigint,total_pixels:bigint,coverage_ratio:double"
BASELINE = (
    "struct<statistics:struct<mean:double,median:double,std:double,min:double,max:double>,"
    "class_imbalance:struct<lobe_pixels:bigint,background_pixels:bigint,lobe_fraction:double,lobe_threshold:double>,"
    "baseline_mae:struct<predict_zero:double,predict_mean:double,predict_median:double,weighted_optimal:double>,"
    "baseline_rmse:struct<predict_zero:double,predict_mean:double>,baseline_iou:struct<predict_zero:double>,"
    "per_class_baselines:struct<lobe:struct<mean:double,mae_predict_zero:double,mae_predict_mean:double>,background:struct<mae_predict_zero:double>>>"
)
ILLUMINATION = "struct<mean_hue:double,mean_saturation:double,mean_value:double>"
FILTERED_TILE = (
    "struct<tile_id:string,features_path:string,targets_path:string,rgb_valid:boolean,has_targets:boolean,"
    f"rgb_stats:struct<{COVERAGE}>,target_stats:struct<positive_pixels:bigint,total_pixels:bigint,coverage_ratio:double,max_value:double,baseline_metrics:{BASELINE}>,"
    f"illumination:string,illumination_metrics:{ILLUMINATION}>"
)
FILTERED_LIST = (
    "filter_config struct<min_rgb_coverage:double,include_background_only:boolean,min_target_coverage:double>, tile_size int, "
    f"stats struct<total_tiles:bigint,rgb_invalid:bigint,background_only:bigint,valid_tiles:bigint,illumination_counts:map<string,bigint>>, tiles array<{FILTERED_TILE}>"
)
BOUNDS = "struct<minx:double,miny:double,maxx:double,maxy:double>"
REGISTRY_ENTRY = (
    f"struct<tile_id:string,tile_idx:int,geographic_bounds:{BOUNDS},pixel_bounds:struct<row_start:bigint,row_end:bigint,col_start:bigint,col_end:bigint>,"
    "filtering:struct<is_valid:boolean,rgb_valid:boolean,has_targets:boolean>,split:string,paths:struct<features:string,targets:string>,inside_boundary:boolean,"
    f"illumination:string,illumination_metrics:{ILLUMINATION},model_metrics:map<string,struct<mae:double,rmse:double,iou:double,improvement_over_baseline:double>>>"
)
REGISTRY = f"metadata struct<source_raster:string,tile_size:int,overlap:double,crs:string,created:string,last_updated:string>, tiles map<string,{REGISTRY_ENTRY}>"
EXTENDED_LIST = (
    "config map<string,string>, stats map<string,bigint>, "
    "tiles array<struct<tile_id:string,features_path:string,targets_path:string,role:string,augment:boolean,illumination:string>>"
)
METRIC_HISTORY = "run_id string, metric string, ts_ms bigint, value double, step int"
RUN_PARAMS = "run_id string, key string, value string"
EDGES = "poly_id bigint, ring_id bigint, edge_seq bigint, x1 double, y1 double, x2 double, y2 double"
