"""DataFrame -> DataFrame operators over log lines and the logs table."""
