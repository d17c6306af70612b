"""Explicit schemas; nothing is inferred. Blanks are null."""

from __future__ import annotations

TELEMETRY = (
    "sample_idx long, test_time double, date_time double, step_time double, step_idx int, cycle_idx int, current double, voltage double, "
    "charge_capacity double, discharge_capacity double, unread_10 double, unread_11 double, unread_12 double, internal_resistance double, "
    "temperature double, shelf_temperature_1 double, shelf_temperature_2 double"
)
METADATA = (
    "idx int, test_id string, device_id string, iv_ch_id int, first_start_datetime long, resumed_times int, last_resume_datetime long, last_end_datetime long, "
    "schedule_file_name string, databases string, item_id string, grade_id int, has_aux int, has_special int, schedule_version string, log_aux_data_flag int, "
    "log_special_data_flag int, rowstate int, canconfig_filename string, m_ncanconfigmd5 string, smbconfig_filename string, smbconfigmd5 string, value double, value2 double"
)
POLICIES = "c1 double, c2 double, c3 double, c4 double"
PREDICTIONS = f"{POLICIES}, life double"
BATCH = "c1 double, c2 double, c3 double"
POSTERIOR = "rank int, c1 double, c2 double, c3 double, c4 double, life int"
REPLICATES = "c1 double, c2 double, c3 double, r1 double, r2 double, r3 double, r4 double, r5 double"
RUN_LOG = "beta double, gamma double, epsilon double, seed int, " + ", ".join(f"l{k} double" for k in range(1, 11))
CAPACITY_CURVE = "qvsn double, q_late double, q_early double"
LIVES = "life int"
