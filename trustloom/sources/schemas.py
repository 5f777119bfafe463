"""Explicit schemas of the inputs, so no reader infers anything."""

from __future__ import annotations

SNAPSHOT = "id STRING, timestamp STRING, data MAP<STRING, STRING>"

ELEMENT = "STRUCT<name: STRING, key: MAP<STRING, STRING>>"
UPDATE = (f"STRUCT<path: STRUCT<elem: ARRAY<{ELEMENT}>>, "
          "val: STRUCT<jsonVal: STRING, intVal: STRING, stringVal: STRING, floatVal: DOUBLE>>")
ENVELOPE = f"update STRUCT<timestamp: STRING, update: ARRAY<{UPDATE}>>"

REQUEST = "ids ARRAY<STRING>"

WIDE_SCORE = ("ID STRING, Timestamp STRING, CPUs INT, Sensors INT, Mem INT, Proc INT, "
              "Disks INT, Nets INT")

RULE_FILE = "name STRING, path STRING, severity STRING, rule STRING"
RULE_CORPUS = "id STRING, name STRING, rule STRING"
RULE_CATALOG = "id STRING, name STRING, path STRING, severity STRING, rule STRING"
LABELLED_QUERY = "query STRING, rule_ids STRING"
METRIC_CATALOG = ("name STRING, subservice STRING, type STRING, is_list INT, unit STRING, "
                  "counter INT")

SAMPLE = ("host STRING, path STRING, entity STRING, metric STRING, ts BIGINT, seq BIGINT, "
          "v_num DOUBLE, v_str STRING")
RAW_SNAPSHOT = "host STRING, ts BIGINT, file STRING, content STRING"

HEALTH = ("STRUCT<score: INT, status: STRING, symptoms: ARRAY<STRUCT<symptomType: STRING, "
          "objectiveIndicators: ARRAY<STRUCT<indicatorType: STRING, indicatorValue: DOUBLE>>>>>")
ASSET = (
    "STRUCT<id: STRING, type: STRING, "
    f"serviceDesc: STRUCT<type: STRING, serviceSW: STRING, serviceVersion: STRING, health: {HEALTH}>, "
    "subservices: ARRAY<STRUCT<subserviceDesc: STRUCT<id: STRING, type: STRING, "
    f"subserviceSW: STRING, subserviceVersion: STRING, health: {HEALTH}>>>, "
    "swImageDesc: STRUCT<operatingSystemCodename: STRING, operatingSystemVersion: STRING>, "
    "virtualStorageDesc: ARRAY<STRUCT<sizeOfStorage: INT, sizeOfStorageUnit: STRING, "
    f"health: {HEALTH}>>, "
    "virtualComputeDesc: ARRAY<STRUCT<virtualMemory: STRUCT<virtualMemSize: INT, "
    "virtualMemSizeUnit: STRING>, virtualCpu: ARRAY<STRUCT<numCore: INT, "
    f"processingFrequency: DOUBLE, frequencyUnit: STRING>>, health: {HEALTH}>>, "
    "infrastructureDesc: STRUCT<location: STRUCT<country: STRING, network: STRING, "
    "adressCompatibility: STRING, bandWidth: STRUCT<bandwidthValue: INT, bandwidthUnit: STRING>>, "
    f"health: {HEALTH}>>")
CATALOG = (f"provider STRING, serviceType STRING, id STRING, priceTag INT, levelOfTrust DOUBLE, "
           f"assets ARRAY<{ASSET}>")
USER = ("id STRING, levelOfTrust DOUBLE, "
        "tlas ARRAY<STRUCT<id: STRING, `related-ns`: ARRAY<STRING>>>")
ENTITIES = "ARRAY<STRUCT<entity: STRING, value: STRING, start: INT, end: INT>>"
SERVICES = ("ARRAY<STRUCT<middlebox: STRING, assets: ARRAY<STRUCT<type: STRING, value: STRING>>>>")
