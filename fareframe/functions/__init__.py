"""Column-level rules. Nothing here touches a DataFrame or starts a job."""
