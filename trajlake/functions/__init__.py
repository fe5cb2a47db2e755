"""Column functions over logs, answers, patches and chats; Arrow UDFs where Columns can't express the rule."""
