"""Plans: how the driver tables map onto the experiment data model, the registered queries,
experiment configs and the cross-validation orchestration."""
