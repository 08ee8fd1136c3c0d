"""Runnable jobs: each module has run(spark, ..) for a session, and a command line that makes one."""
