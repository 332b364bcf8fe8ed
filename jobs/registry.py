"""The queries ``jobN_<name>`` and their SQL, for __spark_entry__.py."""

from jobs import announcements, bulletin

QUERIES = {"job1_announcements": announcements.job1_announcements, "job2_bulletin": bulletin.job2_bulletin}
ORACLE_SQL = {"job1_announcements": announcements.SQL, "job2_bulletin": bulletin.SQL}
