"""DataFrame -> DataFrame steps. None of them starts a job."""
