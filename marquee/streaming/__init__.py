"""Structured Streaming jobs: update classification (T1), keyed chat-session
state (T2), the task-queue stream (T3) and the message-log append (T4)."""
