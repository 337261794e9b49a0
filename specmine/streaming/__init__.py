"""Control-event streams: stateless checks, batch forms and stateful processors."""
