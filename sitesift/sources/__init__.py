"""Sources and sinks: site schema (S6), raw layer (S1, S2), silver master,
daily sample and checkpoint (S3-S5)."""
