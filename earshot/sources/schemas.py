"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

AUDIOGRAM = "struct<levels:array<double>,frequencies:array<double>>"
LISTENER_JSON = "map<string,struct<name:string,audiogram_cfs:array<double>,audiogram_levels_l:array<double>,audiogram_levels_r:array<double>>>"
SCENE = (
    "dataset string, room string, scene string, target struct<name:string,time_start:int,time_end:int>, duration int, "
    "interferers array<struct<position:int,time_start:int,time_end:int,type:string,name:string,offset:int>>, SNR double, "
    "listener struct<rotation:array<struct<sample:double,angle:double>>,hrir_filename:array<string>>"
)
RESPONSE = "prompt string, scene string, n_words int, hits int, listener string, system string, correctness double, response string, volume int, signal string"
SCORE = "scene string, listener string, score double"
SIGNAL = "signal_id string, sample_rate int, left array<double>, right array<double>"
PAIRS_JSON = "map<string,array<string>>"
