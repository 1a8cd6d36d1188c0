"""What the program of ``templates`` gives, by hand-checked rows: (owner, ...), see ``templates.expected``."""

OPS = [
    (0, 0, 0, 'assign', 'args', 'x y', ''),
    (0, 1, 0, 'branch', 'if', '', 'x'),
    (0, 2, 1, 'assign', '', 'z', ''),
    (0, 3, 2, 'branch', 'if', '', 'y'),
    (0, 4, 4, 'assign', '', 'z', ''),
    (0, 5, 5, 'assign', '', 'z', ''),
    (0, 6, 3, 'return', '', '', 'z'),
    (1, 0, 0, 'assign', 'args', 'path', ''),
    (1, 1, 0, 'assign', '', 'data', ''),
    (1, 2, 1, 'assign', '', 'data', 'open path'),
    (1, 3, 2, 'enter_except', '', '', ''),
    (1, 4, 2, 'assign', 'except_as', 'err', ''),
    (1, 5, 2, 'call', '', '', 'log err'),
    (1, 6, 2, 'raise', '', '', ''),
    (1, 7, 3, 'enter_except', '', '', ''),
    (1, 8, 3, 'return', '', '', ''),
    (1, 9, 4, 'call', '', '', 'check data'),
    (1, 10, 5, 'enter_finally', '', '', ''),
    (1, 11, 5, 'call', '', '', 'tidy path'),
    (1, 12, 5, 'exit_finally', '', '', ''),
    (1, 13, 6, 'return', '', '', 'data'),
    (2, 0, 0, 'assign', 'args', 'lock items', ''),
    (2, 1, 0, 'assign', '', 'total', ''),
    (2, 2, 0, 'enter_with', '', 'held', 'lock'),
    (2, 3, 1, 'other', 'for_iter_eval', '', 'items'),
    (2, 4, 2, 'branch', 'for', '', ''),
    (2, 5, 3, 'assign', 'for_iter', 'item', ''),
    (2, 6, 3, 'branch', 'if', '', 'item'),
    (2, 7, 6, 'branch', 'continue', '', ''),
    (2, 8, 7, 'assign', 'aug', 'total', 'total item'),
    (2, 9, 5, 'assign', 'aug', 'total', 'total held'),
    (2, 10, 8, 'exit_with', '', '', ''),
    (2, 11, 8, 'return', '', '', 'total'),
    (3, 0, 0, 'assign', 'args', 'msg', ''),
    (3, 1, 0, 'branch', 'match', '', 'msg'),
    (3, 2, 2, 'branch', 'case', 'steps', 'steps'),
    (3, 3, 2, 'assign', '', 'out', 'steps'),
    (3, 4, 3, 'branch', 'case', '', ''),
    (3, 5, 3, 'assign', '', 'out', ''),
    (3, 6, 1, 'return', '', '', 'out'),
    (4, 0, 0, 'assign', 'args', 'a b c', ''),
    (4, 1, 0, 'assign', '', 'base', 'a b'),
    (4, 2, 0, 'assign', 'nested_def', 'inner', 'b base c'),
    (4, 3, 0, 'return', '', '', 'inner'),
    (5, 0, 0, 'assign', 'args', 'n debug', ''),
    (5, 1, 0, 'assign', '', 'quiet', ''),
    (5, 2, 0, 'branch', 'if', '', 'quiet'),
    (5, 3, 1, 'assign', 'aug', 'n', 'n'),
    (5, 4, 3, 'branch', 'while', '', 'n'),
    (5, 5, 4, 'assign', 'aug', 'n', 'n'),
    (5, 6, 4, 'branch', 'if', '', 'n'),
    (5, 7, 6, 'branch', 'break', '', ''),
    (5, 8, 5, 'branch', 'if', '', 'debug'),
    (5, 9, 8, 'branch', 'if', '', 'debug'),
    (5, 10, 10, 'assign', '', 'n', ''),
    (5, 11, 9, 'return', '', '', 'n'),
    (6, 0, 0, 'assign', 'args', 'value', ''),
    (6, 1, 0, 'branch', 'if', '', 'value'),
    (6, 2, 1, 'raise', '', '', 'ValueError value'),
    (6, 3, 2, 'return', '', '', 'check value'),
    (7, 0, 0, 'assign', 'args', 'value', ''),
    (7, 1, 1, 'return', '', '', 'check value'),
    (7, 2, 2, 'enter_except', '', '', ''),
    (7, 3, 2, 'other', '', '', ''),
    (7, 4, 3, 'return', 'implicit', '', ''),
    (8, 0, 0, 'assign', 'args', 'box extra', ''),
    (8, 1, 0, 'assign', '', '', 'extra box'),
    (8, 2, 0, 'call', '', '', 'box.append box extra'),
    (8, 3, 0, 'delete', '', '', 'box'),
    (8, 4, 0, 'assign', '', 'extra.name', 'extra'),
    (8, 5, 0, 'return', 'implicit', '', ''),
    (9, 0, 0, 'assign', 'args', 'rec', ''),
    (9, 1, 0, 'assign', '', 'name', 'rec'),
    (9, 2, 0, 'assign', '', 'size', 'rec.get rec'),
    (9, 3, 0, 'return', '', '', 'name size'),
    (10, 0, 0, 'assign', 'args', 'flag', ''),
    (10, 1, 0, 'branch', 'if', '', 'flag'),
    (10, 2, 1, 'assign', '', 'found', ''),
    (10, 3, 2, 'call', '', '', 'print found'),
    (10, 4, 2, 'return', '', '', 'found'),
    (10, 5, 3, 'call', '', '', 'print flag'),
    (10, 6, 3, 'return', 'implicit', '', ''),
    (11, 0, 0, 'assign', 'args', 'svc', ''),
    (11, 1, 0, 'assign', '', 's', 'Service svc'),
    (11, 2, 0, 'call', '', '', 's.put s svc'),
    (11, 3, 0, 'assign', '', 't', 's LIMIT'),
    (11, 4, 0, 'return', '', '', 'svc t'),
    ('4.inner', 0, 0, 'assign', 'args', 'k', ''),
    ('4.inner', 1, 0, 'return', '', '', 'k base b c'),
    (':Service.drop', 0, 0, 'assign', 'args', 'self', ''),
    (':Service.drop', 1, 0, 'other', '', '', ''),
    (':Service.drop', 2, 0, 'other', '', '', ''),
    (':Service.drop', 3, 0, 'assign', '', 'LIMIT', ''),
    (':Service.drop', 4, 0, 'assign', '', 'self.last', 'again self'),
    (':Service.drop', 5, 0, 'return', 'implicit', '', ''),
    (':Service.put', 0, 0, 'assign', 'args', 'self item', ''),
    (':Service.put', 1, 0, 'call', '', '', 'super().put super item'),
    (':Service.put', 2, 0, 'call', '', '', 'core.size core item'),
    (':Service.put', 3, 0, 'assign', '', 'self.count', 'item self'),
    (':Service.put', 4, 0, 'return', 'implicit', '', ''),
    (':Store.__init__', 0, 0, 'assign', 'args', 'self items', ''),
    (':Store.__init__', 1, 0, 'assign', '', 'self.items', 'items self'),
    (':Store.__init__', 2, 0, 'return', 'implicit', '', ''),
    (':Store.get', 0, 0, 'assign', 'args', 'self', ''),
    (':Store.get', 1, 0, 'return', '', '', 'self.items self'),
    (':Store.put', 0, 0, 'assign', 'args', 'self item', ''),
    (':Store.put', 1, 0, 'call', '', '', 'self.items.append self.items self item'),
    (':Store.put', 2, 0, 'assign', '', 'self.last', 'item self'),
    (':Store.put', 3, 0, 'return', 'implicit', '', ''),
    (':tidy', 0, 0, 'assign', 'args', 'path', ''),
    (':tidy', 1, 0, 'call', '', '', 'os.remove os path'),
    (':tidy', 2, 0, 'return', 'implicit', '', ''),
    ('pkg/core.py:check', 0, 0, 'assign', 'args', 'value', ''),
    ('pkg/core.py:check', 1, 0, 'branch', 'if', '', 'value'),
    ('pkg/core.py:check', 2, 1, 'raise', '', '', 'KeyError value'),
    ('pkg/core.py:check', 3, 2, 'return', '', '', 'size value'),
    ('pkg/core.py:log', 0, 0, 'assign', 'args', 'err', ''),
    ('pkg/core.py:log', 1, 0, 'other', '', '', ''),
    ('pkg/core.py:log', 2, 0, 'call', '', '', 'print err'),
    ('pkg/core.py:log', 3, 0, 'call', '', '', 'json.dumps json err again'),
    ('pkg/core.py:log', 4, 0, 'return', 'implicit', '', ''),
    ('pkg/core.py:size', 0, 0, 'assign', 'args', 'value', ''),
    ('pkg/core.py:size', 1, 0, 'return', '', '', 'len value'),
    ('pkg/late.py:again', 0, 0, 'return', '', '', 'later'),
    ('pkg/late.py:later', 0, 0, 'return', '', '', 'again'),
]

EDGES = [
    (0, 0, 1, 'n'),
    (0, 0, 2, 'n'),
    (0, 1, 3, 'n'),
    (0, 2, 4, 'n'),
    (0, 2, 5, 'n'),
    (0, 4, 3, 'n'),
    (0, 5, 3, 'n'),
    (1, 0, 1, 'n'),
    (1, 1, 2, 'e'),
    (1, 1, 3, 'e'),
    (1, 1, 4, 'n'),
    (1, 1, 5, 'e'),
    (1, 2, 5, 'e'),
    (1, 3, 5, 'e'),
    (1, 4, 5, 'n'),
    (1, 5, 6, 'n'),
    (2, 0, 1, 'n'),
    (2, 1, 2, 'n'),
    (2, 2, 3, 'n'),
    (2, 2, 5, 'n'),
    (2, 3, 6, 'n'),
    (2, 3, 7, 'n'),
    (2, 5, 8, 'n'),
    (2, 6, 2, 'n'),
    (2, 7, 2, 'n'),
    (3, 0, 2, 'n'),
    (3, 0, 3, 'n'),
    (3, 2, 1, 'n'),
    (3, 3, 1, 'n'),
    (5, 0, 1, 'n'),
    (5, 0, 3, 'n'),
    (5, 1, 3, 'n'),
    (5, 3, 4, 'n'),
    (5, 3, 5, 'n'),
    (5, 4, 3, 'n'),
    (5, 4, 6, 'n'),
    (5, 5, 8, 'n'),
    (5, 5, 9, 'n'),
    (5, 6, 5, 'n'),
    (5, 8, 9, 'n'),
    (5, 8, 10, 'n'),
    (5, 10, 9, 'n'),
    (6, 0, 1, 'n'),
    (6, 0, 2, 'n'),
    (7, 0, 1, 'n'),
    (7, 1, 2, 'e'),
    (7, 2, 3, 'n'),
    (10, 0, 1, 'n'),
    (10, 0, 2, 'n'),
    (10, 1, 2, 'n'),
    ('pkg/core.py:check', 0, 1, 'n'),
    ('pkg/core.py:check', 0, 2, 'n'),
]

EXITS = [
    (0, '3', 'x y z', ''),
    (1, '2 3 6', 'data err path', ''),
    (2, '8', 'held item items lock total', ''),
    (3, '1', 'msg out steps', ''),
    (4, '0', 'a b base c inner', ''),
    (5, '9', 'debug n quiet', ''),
    (6, '1 2', 'value', ''),
    (7, '1 3', 'value', ''),
    (8, '0', 'box extra', ''),
    (9, '0', 'name rec size', ''),
    (10, '2 3', 'flag found', ''),
    (11, '0', 's svc t', ''),
    ('4.inner', '0', 'k', 'b base c'),
    (':Service.drop', '0', 'LIMIT self', ''),
    (':Service.put', '0', 'item self', '__class__'),
    (':Store.__init__', '0', 'items self', ''),
    (':Store.get', '0', 'self', ''),
    (':Store.put', '0', 'item self', ''),
    (':tidy', '0', 'path', ''),
    ('pkg/core.py:check', '1 2', 'value', ''),
    ('pkg/core.py:log', '0', 'err', ''),
    ('pkg/core.py:size', '0', 'value', ''),
    ('pkg/late.py:again', '0', '', ''),
    ('pkg/late.py:later', '0', '', ''),
]

METRICS = [
    (0, 6, 7, 2, 1, 5, 3, 3, 2, 1, 5, 4, 0),
    (1, 7, 9, 0, 3, 4, 9, 3, 0, 0, 5, 11, 0),
    (2, 8, 9, 3, 1, 7, 8, 3, 3, 1, 10, 8, 2),
    (3, 4, 4, 3, 1, 4, 4, 2, 4, 1, 4, 3, 0),
    (4, 1, 0, 0, 1, 5, 6, 1, 0, 0, 6, 2, 0),
    (5, 9, 13, 6, 1, 6, 8, 6, 7, 2, 15, 11, 1),
    (6, 3, 2, 1, 2, 1, 5, 2, 1, 1, 3, 3, 0),
    (7, 4, 3, 0, 2, 1, 2, 2, 0, 0, 1, 1, 0),
    (8, 1, 0, 0, 1, 3, 7, 1, 0, 0, 6, 4, 0),
    (9, 1, 0, 0, 1, 3, 5, 1, 0, 0, 4, 2, 0),
    (10, 4, 3, 1, 2, 2, 6, 2, 1, 1, 3, 2, 0),
    (11, 1, 0, 0, 1, 3, 9, 1, 0, 0, 6, 4, 0),
    ('4.inner', 1, 0, 0, 1, 1, 4, 1, 0, 0, 1, 1, 0),
    (':Service.drop', 1, 0, 0, 1, 3, 2, 1, 0, 0, 1, 4, 0),
    (':Service.put', 1, 0, 0, 1, 3, 8, 1, 0, 0, 4, 3, 0),
    (':Store.__init__', 1, 0, 0, 1, 3, 2, 1, 0, 0, 2, 1, 0),
    (':Store.get', 1, 0, 0, 1, 1, 2, 1, 0, 0, 1, 1, 0),
    (':Store.put', 1, 0, 0, 1, 3, 6, 1, 0, 0, 4, 2, 0),
    (':tidy', 1, 0, 0, 1, 1, 3, 1, 0, 0, 1, 1, 0),
    ('pkg/core.py:check', 3, 2, 1, 2, 1, 5, 2, 1, 1, 3, 3, 0),
    ('pkg/core.py:log', 1, 0, 0, 1, 1, 6, 1, 0, 0, 2, 3, 0),
    ('pkg/core.py:size', 1, 0, 0, 1, 1, 2, 1, 0, 0, 1, 1, 0),
    ('pkg/late.py:again', 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0),
    ('pkg/late.py:later', 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0),
]

FINDINGS = [
    (4, 0, 'scope-coupling', 'closure-capture', 3, 'may', 'heuristic'),
    (5, 0, 'const-branch', 'constant_name', 2, 'must', 'sound'),
    (5, 1, 'redundant-branch', 'implied_condition', 9, 'must', 'sound'),
    (8, 0, 'input-mutation', 'subscript-store', 1, 'may', 'heuristic'),
    (8, 1, 'input-mutation', 'method-mutation', 2, 'may', 'heuristic'),
    (8, 2, 'input-mutation', 'subscript-del', 3, 'may', 'heuristic'),
    (8, 3, 'input-mutation', 'attr-store', 4, 'may', 'heuristic'),
    (9, 0, 'lossy-projection', 'unsourced-field', 3, 'may', 'heuristic'),
    (9, 1, 'lossy-projection', 'closed-projection', 3, 'may', 'heuristic'),
    (10, 0, 'unreachable', 'unreachable', 5, 'must', 'sound'),
    (10, 1, 'use-before-def', 'maybe_unbound', 3, 'may', 'heuristic'),
    (10, 2, 'use-before-def', 'maybe_unbound', 4, 'may', 'heuristic'),
]

CONSTANTS = [
    (1, 1, 'data=None'),
    (2, 1, 'total=0'),
    (5, 1, 'quiet=True'),
    (5, 3, 'quiet=True'),
    (5, 4, 'quiet=True'),
    (5, 5, 'quiet=True'),
    (5, 6, 'quiet=True'),
    (5, 8, 'quiet=True'),
    (5, 9, 'quiet=True'),
    (5, 10, 'quiet=True'),
    (10, 2, 'found=1'),
]

OVERLOADED = [
    (2, 'total', 2),
]

REGIONS = [
    (2, 2, 2),
    (2, 2, 3),
    (2, 2, 6),
    (2, 2, 7),
    (5, 3, 3),
    (5, 3, 4),
]

OUTPUTS = [
    (0, '<return><-x'),
    (0, '<return><-y'),
    (1, '<return><-open'),
    (1, '<return><-path'),
    (2, '<return><-lock'),
    (3, '<return><-msg'),
    (3, '<return><-steps'),
    (4, '<return><-a'),
    (4, '<return><-b'),
    (4, '<return><-c'),
    (5, '<return><-debug'),
    (5, '<return><-n'),
    (6, '<return><-check'),
    (6, '<return><-value'),
    (7, '<return><-check'),
    (7, '<return><-value'),
    (9, '<return><-rec'),
    (9, '<return><-rec.get'),
    (10, '<return><-flag'),
    (11, '<return><-LIMIT'),
    (11, '<return><-Service'),
    (11, '<return><-svc'),
    ('4.inner', '<return><-b'),
    ('4.inner', '<return><-base'),
    ('4.inner', '<return><-c'),
    ('4.inner', '<return><-k'),
    (':Service.drop', 'self.last<-again'),
    (':Service.drop', 'self.last<-self'),
    (':Service.put', 'self.count<-item'),
    (':Service.put', 'self.count<-self'),
    (':Store.__init__', 'self.items<-items'),
    (':Store.__init__', 'self.items<-self'),
    (':Store.get', '<return><-self'),
    (':Store.get', '<return><-self.items'),
    (':Store.put', 'self.last<-item'),
    (':Store.put', 'self.last<-self'),
    ('pkg/core.py:check', '<return><-size'),
    ('pkg/core.py:check', '<return><-value'),
    ('pkg/core.py:size', '<return><-len'),
    ('pkg/core.py:size', '<return><-value'),
    ('pkg/late.py:again', '<return><-later'),
    ('pkg/late.py:later', '<return><-again'),
]

WALKS = [
    (0, 0, 0, 'block', 0, '', 'start', -1, False),
    (0, 1, 1, 'block', 1, '', 'control', 0, False),
    (0, 2, 1, 'block', 2, '', 'control', 0, False),
    (0, 3, 2, 'block', 3, '', 'control', 1, False),
    (0, 4, 2, 'block', 4, '', 'control', 2, False),
    (0, 5, 2, 'block', 5, '', 'control', 2, False),
    (1, 0, 0, 'block', 0, '', 'start', -1, False),
    (1, 1, 1, 'block', 1, '', 'control', 0, False),
    (1, 2, 2, 'block', 4, '', 'control', 1, False),
    (1, 3, 2, 'block', 2, '', 'except', 1, False),
    (1, 4, 2, 'block', 3, '', 'except', 1, False),
    (1, 5, 2, 'block', 5, '', 'except', 1, False),
    (1, 6, 3, 'block', 6, '', 'control', 5, False),
    (2, 0, 0, 'block', 0, '', 'start', -1, False),
    (2, 1, 1, 'block', 1, '', 'control', 0, False),
    (2, 2, 2, 'block', 2, '', 'control', 1, False),
    (2, 3, 3, 'block', 3, '', 'control', 2, True),
    (2, 4, 3, 'block', 5, '', 'control', 2, True),
    (3, 0, 0, 'block', 0, '', 'start', -1, False),
    (3, 1, 1, 'block', 2, '', 'control', 0, False),
    (3, 2, 1, 'block', 3, '', 'control', 0, False),
    (3, 3, 2, 'block', 1, '', 'control', 1, False),
    (4, 0, 0, 'block', 0, '', 'start', -1, False),
    (5, 0, 0, 'block', 0, '', 'start', -1, False),
    (5, 1, 1, 'block', 1, '', 'control', 0, False),
    (5, 2, 1, 'block', 3, '', 'control', 0, False),
    (5, 3, 2, 'block', 4, '', 'control', 2, False),
    (5, 4, 2, 'block', 5, '', 'control', 2, False),
    (5, 5, 3, 'block', 6, '', 'control', 3, True),
    (5, 6, 3, 'block', 8, '', 'control', 4, True),
    (5, 7, 3, 'block', 9, '', 'control', 4, False),
    (6, 0, 0, 'block', 0, '', 'start', -1, False),
    (6, 1, 1, 'block', 1, '', 'control', 0, False),
    (6, 2, 1, 'block', 2, '', 'control', 0, False),
    (7, 0, 0, 'block', 0, '', 'start', -1, False),
    (7, 1, 1, 'block', 1, '', 'control', 0, False),
    (7, 2, 2, 'block', 2, '', 'except', 1, False),
    (7, 3, 3, 'block', 3, '', 'control', 2, False),
    (8, 0, 0, 'block', 0, '', 'start', -1, False),
    (9, 0, 0, 'block', 0, '', 'start', -1, False),
    (10, 0, 0, 'block', 0, '', 'start', -1, False),
    (10, 1, 1, 'block', 1, '', 'control', 0, False),
    (10, 2, 1, 'block', 2, '', 'control', 0, False),
    (11, 0, 0, 'block', 0, '', 'start', -1, False),
    ('4.inner', 0, 0, 'block', 0, '', 'start', -1, False),
    (':Service.drop', 0, 0, 'block', 0, '', 'start', -1, False),
    (':Service.put', 0, 0, 'block', 0, '', 'start', -1, False),
    (':Store.__init__', 0, 0, 'block', 0, '', 'start', -1, False),
    (':Store.get', 0, 0, 'block', 0, '', 'start', -1, False),
    (':Store.put', 0, 0, 'block', 0, '', 'start', -1, False),
    (':tidy', 0, 0, 'block', 0, '', 'start', -1, False),
    ('pkg/core.py:check', 0, 0, 'block', 0, '', 'start', -1, False),
    ('pkg/core.py:check', 1, 1, 'block', 1, '', 'control', 0, False),
    ('pkg/core.py:check', 2, 1, 'block', 2, '', 'control', 0, False),
    ('pkg/core.py:log', 0, 0, 'block', 0, '', 'start', -1, False),
    ('pkg/core.py:size', 0, 0, 'block', 0, '', 'start', -1, False),
    ('pkg/late.py:again', 0, 0, 'block', 0, '', 'start', -1, False),
    ('pkg/late.py:later', 0, 0, 'block', 0, '', 'start', -1, False),
]

SLICES = [
    (0, 'op:6', 0, 'op', 6, 'return', 'start'),
    (0, 'op:6', 1, 'use', 2, 'z', 'data'),
    (0, 'op:6', 2, 'def', 2, 'z', 'data'),
    (0, 'op:6', 3, 'def', 3, 'z', 'data'),
    (0, 'op:6', 4, 'def', 4, 'z', 'data'),
    (0, 'op:6', 5, 'op', 1, 'branch', 'ctrl-dep'),
    (0, 'op:6', 6, 'op', 2, 'assign', 'data'),
    (0, 'op:6', 7, 'op', 4, 'assign', 'data'),
    (0, 'op:6', 8, 'op', 3, 'branch', 'ctrl-dep'),
    (0, 'op:6', 9, 'op', 5, 'assign', 'data'),
    (0, 'op:6', 10, 'use', 0, 'x', 'data'),
    (0, 'op:6', 11, 'use', 1, 'y', 'data'),
    (0, 'op:6', 12, 'def', 0, 'x', 'data'),
    (0, 'op:6', 13, 'def', 1, 'y', 'data'),
    (1, 'op:13', 0, 'op', 13, 'return', 'start'),
    (1, 'op:13', 1, 'use', 8, 'data', 'data'),
    (1, 'op:13', 2, 'def', 2, 'data', 'data'),
    (1, 'op:13', 3, 'op', 2, 'assign', 'data'),
    (1, 'op:13', 4, 'use', 0, 'open', 'data'),
    (1, 'op:13', 5, 'use', 1, 'path', 'data'),
    (1, 'op:13', 6, 'def', 0, 'path', 'data'),
    (2, 'op:11', 0, 'op', 11, 'return', 'start'),
    (2, 'op:11', 1, 'use', 7, 'total', 'data'),
    (2, 'op:11', 2, 'def', 5, 'total', 'data'),
    (2, 'op:11', 3, 'op', 9, 'assign', 'data'),
    (2, 'op:11', 4, 'use', 3, 'total', 'data'),
    (2, 'op:11', 5, 'use', 4, 'held', 'data'),
    (2, 'op:11', 6, 'def', 2, 'total', 'data'),
    (2, 'op:11', 7, 'def', 6, 'total', 'data'),
    (2, 'op:11', 8, 'def', 3, 'held', 'data'),
    (3, 'op:6', 0, 'op', 6, 'return', 'start'),
    (3, 'op:6', 1, 'use', 1, 'out', 'data'),
    (3, 'op:6', 2, 'def', 2, 'out', 'data'),
    (3, 'op:6', 3, 'def', 3, 'out', 'data'),
    (3, 'op:6', 4, 'op', 1, 'branch', 'ctrl-dep'),
    (3, 'op:6', 5, 'op', 3, 'assign', 'data'),
    (3, 'op:6', 6, 'op', 5, 'assign', 'data'),
    (3, 'op:6', 7, 'use', 0, 'msg', 'data'),
    (3, 'op:6', 8, 'use', 3, 'steps', 'data'),
    (3, 'op:6', 9, 'def', 0, 'msg', 'data'),
    (3, 'op:6', 10, 'def', 1, 'steps', 'data'),
    (4, 'op:3', 0, 'op', 3, 'return', 'start'),
    (4, 'op:3', 1, 'use', 5, 'inner', 'data'),
    (4, 'op:3', 2, 'def', 4, 'inner', 'data'),
    (4, 'op:3', 3, 'op', 2, 'assign', 'data'),
    (4, 'op:3', 4, 'use', 2, 'b', 'data'),
    (4, 'op:3', 5, 'use', 3, 'base', 'data'),
    (4, 'op:3', 6, 'use', 4, 'c', 'data'),
    (4, 'op:3', 7, 'def', 1, 'b', 'data'),
    (4, 'op:3', 8, 'def', 3, 'base', 'data'),
    (4, 'op:3', 9, 'def', 2, 'c', 'data'),
    (5, 'op:11', 0, 'op', 11, 'return', 'start'),
    (5, 'op:11', 1, 'use', 7, 'n', 'data'),
    (5, 'op:11', 2, 'def', 0, 'n', 'data'),
    (5, 'op:11', 3, 'def', 3, 'n', 'data'),
    (5, 'op:11', 4, 'def', 4, 'n', 'data'),
    (5, 'op:11', 5, 'def', 5, 'n', 'data'),
    (5, 'op:11', 6, 'op', 0, 'assign', 'data'),
    (5, 'op:11', 7, 'op', 2, 'branch', 'ctrl-dep'),
    (5, 'op:11', 8, 'op', 3, 'assign', 'data'),
    (5, 'op:11', 9, 'op', 5, 'assign', 'data'),
    (5, 'op:11', 10, 'op', 9, 'branch', 'ctrl-dep'),
    (5, 'op:11', 11, 'op', 10, 'assign', 'data'),
    (5, 'op:11', 12, 'use', 0, 'quiet', 'data'),
    (5, 'op:11', 13, 'use', 1, 'n', 'data'),
    (5, 'op:11', 14, 'op', 4, 'branch', 'ctrl-dep'),
    (5, 'op:11', 15, 'use', 3, 'n', 'data'),
    (5, 'op:11', 16, 'op', 8, 'branch', 'ctrl-dep'),
    (5, 'op:11', 17, 'use', 6, 'debug', 'data'),
    (5, 'op:11', 18, 'def', 2, 'quiet', 'data'),
    (5, 'op:11', 19, 'op', 6, 'branch', 'ctrl-dep'),
    (5, 'op:11', 20, 'use', 2, 'n', 'data'),
    (5, 'op:11', 21, 'use', 5, 'debug', 'data'),
    (5, 'op:11', 22, 'def', 1, 'debug', 'data'),
    (6, 'op:3', 0, 'op', 3, 'return', 'start'),
    (6, 'op:3', 1, 'op', 1, 'branch', 'ctrl-dep'),
    (6, 'op:3', 2, 'use', 3, 'check', 'data'),
    (6, 'op:3', 3, 'use', 4, 'value', 'data'),
    (6, 'op:3', 4, 'use', 0, 'value', 'data'),
    (6, 'op:3', 5, 'def', 0, 'value', 'data'),
    (6, 'op:3', 6, 'op', 0, 'assign', 'data'),
    (7, 'op:1', 0, 'op', 1, 'return', 'start'),
    (7, 'op:1', 1, 'use', 0, 'check', 'data'),
    (7, 'op:1', 2, 'use', 1, 'value', 'data'),
    (7, 'op:1', 3, 'def', 0, 'value', 'data'),
    (7, 'op:1', 4, 'op', 0, 'assign', 'data'),
    (9, 'op:3', 0, 'op', 3, 'return', 'start'),
    (9, 'op:3', 1, 'use', 3, 'name', 'data'),
    (9, 'op:3', 2, 'use', 4, 'size', 'data'),
    (9, 'op:3', 3, 'def', 1, 'name', 'data'),
    (9, 'op:3', 4, 'def', 2, 'size', 'data'),
    (9, 'op:3', 5, 'op', 1, 'assign', 'data'),
    (9, 'op:3', 6, 'op', 2, 'assign', 'data'),
    (9, 'op:3', 7, 'use', 0, 'rec', 'data'),
    (9, 'op:3', 8, 'use', 1, 'rec.get', 'data'),
    (9, 'op:3', 9, 'use', 2, 'rec', 'data'),
    (9, 'op:3', 10, 'def', 0, 'rec', 'data'),
    (10, 'op:4', 0, 'op', 4, 'return', 'start'),
    (10, 'op:4', 1, 'use', 3, 'found', 'data'),
    (10, 'op:4', 2, 'def', 1, 'found', 'data'),
    (10, 'op:4', 3, 'op', 2, 'assign', 'data'),
    (10, 'op:4', 4, 'op', 1, 'branch', 'ctrl-dep'),
    (10, 'op:4', 5, 'use', 0, 'flag', 'data'),
    (11, 'op:4', 0, 'op', 4, 'return', 'start'),
    (11, 'op:4', 1, 'use', 7, 'svc', 'data'),
    (11, 'op:4', 2, 'use', 8, 't', 'data'),
    (11, 'op:4', 3, 'def', 0, 'svc', 'data'),
    (11, 'op:4', 4, 'def', 2, 't', 'data'),
    (11, 'op:4', 5, 'op', 0, 'assign', 'data'),
    (11, 'op:4', 6, 'op', 3, 'assign', 'data'),
    (11, 'op:4', 7, 'use', 5, 's', 'data'),
    (11, 'op:4', 8, 'use', 6, 'LIMIT', 'data'),
    (11, 'op:4', 9, 'def', 1, 's', 'data'),
    ('4.inner', 'op:1', 0, 'op', 1, 'return', 'start'),
    ('4.inner', 'op:1', 1, 'use', 0, 'k', 'data'),
    ('4.inner', 'op:1', 2, 'use', 1, 'base', 'data'),
    ('4.inner', 'op:1', 3, 'use', 2, 'b', 'data'),
    ('4.inner', 'op:1', 4, 'use', 3, 'c', 'data'),
    ('4.inner', 'op:1', 5, 'def', 0, 'k', 'data'),
    ('4.inner', 'op:1', 6, 'op', 0, 'assign', 'data'),
    (':Store.get', 'op:1', 0, 'op', 1, 'return', 'start'),
    (':Store.get', 'op:1', 1, 'use', 0, 'self.items', 'data'),
    (':Store.get', 'op:1', 2, 'use', 1, 'self', 'data'),
    (':Store.get', 'op:1', 3, 'def', 0, 'self', 'data'),
    (':Store.get', 'op:1', 4, 'op', 0, 'assign', 'data'),
    ('pkg/core.py:check', 'op:3', 0, 'op', 3, 'return', 'start'),
    ('pkg/core.py:check', 'op:3', 1, 'op', 1, 'branch', 'ctrl-dep'),
    ('pkg/core.py:check', 'op:3', 2, 'use', 3, 'size', 'data'),
    ('pkg/core.py:check', 'op:3', 3, 'use', 4, 'value', 'data'),
    ('pkg/core.py:check', 'op:3', 4, 'use', 0, 'value', 'data'),
    ('pkg/core.py:check', 'op:3', 5, 'def', 0, 'value', 'data'),
    ('pkg/core.py:check', 'op:3', 6, 'op', 0, 'assign', 'data'),
    ('pkg/core.py:size', 'op:1', 0, 'op', 1, 'return', 'start'),
    ('pkg/core.py:size', 'op:1', 1, 'use', 0, 'len', 'data'),
    ('pkg/core.py:size', 'op:1', 2, 'use', 1, 'value', 'data'),
    ('pkg/core.py:size', 'op:1', 3, 'def', 0, 'value', 'data'),
    ('pkg/core.py:size', 'op:1', 4, 'op', 0, 'assign', 'data'),
    ('pkg/late.py:again', 'op:0', 0, 'op', 0, 'return', 'start'),
    ('pkg/late.py:again', 'op:0', 1, 'use', 0, 'later', 'data'),
    ('pkg/late.py:later', 'op:0', 0, 'op', 0, 'return', 'start'),
    ('pkg/late.py:later', 'op:0', 1, 'use', 0, 'again', 'data'),
]

GUARDS = [
    (0, 2, 1, 1, 'x', 'then'),
    (0, 3, 1, 1, 'x', 'else'),
    (0, 4, 1, 3, 'y', 'then'),
    (0, 4, 2, 1, 'x', 'else'),
    (0, 6, 1, 3, 'y', 'else'),
    (0, 6, 2, 1, 'x', 'else'),
    (2, 4, 1, 4, None, 'then'),
    (2, 5, 1, 6, 'item is None', 'then'),
    (2, 5, 2, 4, None, 'then'),
    (2, 6, 1, 6, 'item is None', 'else'),
    (2, 6, 2, 4, None, 'then'),
    (3, 2, 1, 1, 'msg', 'then'),
    (3, 3, 1, 1, 'msg', 'then'),
    (3, 4, 1, 1, 'msg', 'else'),
    (3, 5, 1, 1, 'msg', 'else'),
    (5, 3, 1, 2, 'quiet', 'then'),
    (5, 4, 1, 6, 'n == 5', None),
    (5, 5, 1, 4, 'n > 0', 'then'),
    (5, 6, 1, 4, 'n > 0', 'then'),
    (5, 7, 1, 6, 'n == 5', 'then'),
    (5, 7, 2, 4, 'n > 0', 'then'),
    (5, 9, 1, 8, 'debug', 'then'),
    (5, 10, 1, 9, 'not debug', 'then'),
    (5, 10, 2, 8, 'debug', 'then'),
    (6, 2, 1, 1, 'not value', 'then'),
    (6, 3, 1, 1, 'not value', 'else'),
    (10, 2, 1, 1, 'flag', 'then'),
    ('pkg/core.py:check', 2, 1, 1, 'value is None', 'then'),
    ('pkg/core.py:check', 3, 1, 1, 'value is None', 'else'),
]

PATHS = [
    (0, '0>1>3'),
    (0, '0>2>4>3'),
    (0, '0>2>5>3'),
    (1, '0>1>2'),
    (1, '0>1>2>5>6'),
    (1, '0>1>3'),
    (1, '0>1>3>5>6'),
    (1, '0>1>4>5>6'),
    (1, '0>1>5>6'),
    (2, '0>1>2>5>8'),
    (3, '0>2>1'),
    (3, '0>3>1'),
    (4, '0'),
    (5, '0>1>3>4>6>5>8>10>9'),
    (5, '0>1>3>4>6>5>8>9'),
    (5, '0>1>3>4>6>5>9'),
    (5, '0>1>3>5>8>10>9'),
    (5, '0>1>3>5>8>9'),
    (5, '0>1>3>5>9'),
    (5, '0>3>4>6>5>8>10>9'),
    (5, '0>3>4>6>5>8>9'),
    (5, '0>3>4>6>5>9'),
    (5, '0>3>5>8>10>9'),
    (5, '0>3>5>8>9'),
    (5, '0>3>5>9'),
    (6, '0>1'),
    (6, '0>2'),
    (7, '0>1'),
    (7, '0>1>2>3'),
    (8, '0'),
    (9, '0'),
    (10, '0>1>2'),
    (10, '0>2'),
    (11, '0'),
    ('4.inner', '0'),
    (':Service.drop', '0'),
    (':Service.put', '0'),
    (':Store.__init__', '0'),
    (':Store.get', '0'),
    (':Store.put', '0'),
    (':tidy', '0'),
    ('pkg/core.py:check', '0>1'),
    ('pkg/core.py:check', '0>2'),
    ('pkg/core.py:log', '0'),
    ('pkg/core.py:size', '0'),
    ('pkg/late.py:again', '0'),
    ('pkg/late.py:later', '0'),
]

CALLS = [
    (1, 'check', 'pkg/core.py:check', 'import', 1),
    (1, 'log', 'pkg/core.py:log', 'import', 1),
    (1, 'open', None, 'builtin', 0),
    (1, 'tidy', 'FILE:tidy', 'same-module', 1),
    (6, 'check', 'pkg/core.py:check', 'import', 1),
    (7, 'check', 'pkg/core.py:check', 'import', 1),
    (8, 'box.append', None, 'global', 0),
    (9, 'rec.get', 'FILE:Store.get', 'global', 1),
    (10, 'print', None, 'builtin', 0),
    (11, 'Service', None, 'ctor', 0),
    (11, 's.put', 'FILE:Service.put', 'global', 2),
    (11, 's.put', 'FILE:Store.put', 'global', 2),
    (':Service.drop', 'again', 'pkg/late.py:again', 'import', 1),
    (':Service.put', 'core.size', 'pkg/core.py:size', 'import', 1),
    (':Service.put', 'super', None, 'builtin', 0),
    (':Service.put', 'super().put', 'FILE:Store.put', 'self', 1),
    (':Store.put', 'self.items.append', None, 'global', 0),
    (':tidy', 'os.remove', None, 'import', 0),
    ('pkg/core.py:check', 'size', 'pkg/core.py:size', 'same-module', 1),
    ('pkg/core.py:log', 'json.dumps', None, 'import', 0),
    ('pkg/core.py:log', 'print', None, 'builtin', 0),
    ('pkg/core.py:size', 'len', None, 'builtin', 0),
    ('pkg/late.py:again', 'later', 'pkg/late.py:later', 'same-module', 1),
    ('pkg/late.py:later', 'again', 'pkg/late.py:again', 'same-module', 1),
]

EDGES_BETWEEN = [
    (1, 'FILE:tidy', 1, 0, 0),
    (1, 'pkg/core.py:check', 1, 0, 0),
    (1, 'pkg/core.py:log', 1, 0, 0),
    (6, 'pkg/core.py:check', 1, 0, 0),
    (7, 'pkg/core.py:check', 1, 0, 0),
    (9, 'FILE:Store.get', 1, 0, 1),
    (11, 'FILE:Service.put', 2, 0, 1),
    (11, 'FILE:Store.put', 2, 0, 1),
    (':Service.drop', 'pkg/late.py:again', 1, 0, 0),
    (':Service.put', 'FILE:Store.put', 1, 0, 0),
    (':Service.put', 'pkg/core.py:size', 1, 0, 0),
    ('pkg/core.py:check', 'pkg/core.py:size', 1, 0, 0),
    ('pkg/late.py:again', 'pkg/late.py:later', 1, 0, 0),
    ('pkg/late.py:later', 'pkg/late.py:again', 1, 0, 0),
]

HANDLERS = [
    (1, 2, '(OSError, ValueError)', 'err', 're-raise', '', 'log', False),
    (1, 3, 'KeyError', None, 'return', '', '', False),
    (7, 2, 'LookupError', None, 'return', '', '', False),
]

RAISES = [
    (1, 'OSError', False),
    (1, 'ValueError', False),
    (6, 'ValueError', False),
    (8, 'AttributeError', True),
    (9, 'AttributeError', True),
    (9, 'IndexError', True),
    (9, 'KeyError', True),
    (11, 'AttributeError', True),
    (':Service.put', 'AttributeError', True),
    (':Store.get', 'AttributeError', True),
    (':Store.put', 'AttributeError', True),
    (':tidy', 'AttributeError', True),
    ('pkg/core.py:check', 'KeyError', False),
    ('pkg/core.py:log', 'AttributeError', True),
]

ESCAPES = [
    (1, 'KeyError', 1, 'SELF < pkg/core.py:check'),
    (1, 'OSError', 0, 'SELF'),
    (1, 'ValueError', 0, 'SELF'),
    (6, 'KeyError', 1, 'SELF < pkg/core.py:check'),
    (6, 'ValueError', 0, 'SELF'),
    ('pkg/core.py:check', 'KeyError', 0, 'pkg/core.py:check'),
]

STATE = [
    (11, 'FILE:GLOBAL:LIMIT', 'global', 'r'),
    (':Service.drop', 'FILE:GLOBAL:LIMIT', 'global', 'w'),
    (':Service.drop', 'FILE:Service.last', 'attr', 'w'),
    (':Service.put', 'FILE:Service.count', 'attr', 'w'),
    (':Store.__init__', 'FILE:Store.items', 'attr', 'w'),
    (':Store.get', 'FILE:Store.items', 'attr', 'r'),
    (':Store.put', 'FILE:Store.items', 'attr', 'r'),
    (':Store.put', 'FILE:Store.last', 'attr', 'w'),
]

TRACE = [
    (0, 'x', 'SELF', 'x', 0, 'origin'),
    (1, 'path', 'FILE:tidy', 'path', 1, 'arg'),
    (1, 'path', 'SELF', 'data', 1, 'assign'),
    (1, 'path', 'SELF', 'path', 0, 'origin'),
    (1, 'path', 'pkg/core.py:check', 'value', 2, 'arg'),
    (1, 'path', 'pkg/core.py:size', 'value', 3, 'arg'),
    (2, 'lock', 'SELF', 'held', 1, 'assign'),
    (2, 'lock', 'SELF', 'lock', 0, 'origin'),
    (2, 'lock', 'SELF', 'total', 2, 'assign'),
    (3, 'msg', 'SELF', 'msg', 0, 'origin'),
    (4, 'a', 'SELF', 'a', 0, 'origin'),
    (4, 'a', 'SELF', 'base', 1, 'assign'),
    (4, 'a', 'SELF', 'inner', 2, 'assign'),
    (5, 'n', 'SELF', 'n', 0, 'origin'),
    (6, 'value', 'SELF', 'value', 0, 'origin'),
    (6, 'value', 'pkg/core.py:check', 'value', 1, 'arg'),
    (6, 'value', 'pkg/core.py:size', 'value', 2, 'arg'),
    (7, 'value', 'SELF', 'value', 0, 'origin'),
    (7, 'value', 'pkg/core.py:check', 'value', 1, 'arg'),
    (7, 'value', 'pkg/core.py:size', 'value', 2, 'arg'),
    (8, 'box', 'SELF', 'box', 0, 'origin'),
    (9, 'rec', 'SELF', 'name', 1, 'assign'),
    (9, 'rec', 'SELF', 'rec', 0, 'origin'),
    (9, 'rec', 'SELF', 'size', 1, 'assign'),
    (10, 'flag', 'SELF', 'flag', 0, 'origin'),
    (11, 'svc', 'FILE:Service.put', 'item', 1, 'arg'),
    (11, 'svc', 'FILE:Service.put', 'self.count', 2, 'store'),
    (11, 'svc', 'FILE:Store.put', 'item', 1, 'arg'),
    (11, 'svc', 'FILE:Store.put', 'self.last', 2, 'store'),
    (11, 'svc', 'SELF', 's', 1, 'assign'),
    (11, 'svc', 'SELF', 'svc', 0, 'origin'),
    (11, 'svc', 'SELF', 't', 2, 'assign'),
    (11, 'svc', 'pkg/core.py:size', 'value', 2, 'arg'),
]

OVERRIDES = [
    (':', 'FILE:Service', 'FILE:Store', 'put'),
]

IMPORTS = [
    (':', 'pkg/core.py', 'pkg.core', False),
    (':', 'pkg/core.py', 'pkg.core.check', False),
    (':', 'pkg/core.py', 'pkg.core.log', False),
    (':', 'pkg/late.py', 'pkg.late.again', True),
    (':', None, 'os', False),
    ('pkg/core.py:', 'pkg/late.py', 'pkg.late.again', True),
    ('pkg/core.py:', None, 'json', False),
    ('pkg/late.py:', 'pkg/core.py', 'pkg.core', False),
]

TREES = [
    (0, 'SELF', 0, ''),
    (1, 'SELF', 0, ''),
    (1, 'SELF > FILE:tidy', 1, ''),
    (1, 'SELF > pkg/core.py:check', 1, ''),
    (1, 'SELF > pkg/core.py:check > pkg/core.py:size', 2, ''),
    (1, 'SELF > pkg/core.py:log', 1, ''),
    (2, 'SELF', 0, ''),
    (3, 'SELF', 0, ''),
    (4, 'SELF', 0, ''),
    (5, 'SELF', 0, ''),
    (6, 'SELF', 0, ''),
    (6, 'SELF > pkg/core.py:check', 1, ''),
    (6, 'SELF > pkg/core.py:check > pkg/core.py:size', 2, ''),
    (7, 'SELF', 0, ''),
    (7, 'SELF > pkg/core.py:check', 1, ''),
    (7, 'SELF > pkg/core.py:check > pkg/core.py:size', 2, ''),
    (8, 'SELF', 0, ''),
    (9, 'SELF', 0, ''),
    (9, 'SELF > FILE:Store.get', 1, ''),
    (10, 'SELF', 0, ''),
    (11, 'SELF', 0, ''),
    (11, 'SELF > FILE:Service.put', 1, 'ambiguous'),
    (11, 'SELF > FILE:Store.put', 1, 'ambiguous'),
]

FOOTPRINTS = [
    (11, 'FILE:GLOBAL:LIMIT', ''),
    (':Service.drop', '', 'FILE:GLOBAL:LIMIT FILE:Service.last'),
    (':Service.put', '', 'FILE:Service.count'),
    (':Store.__init__', '', 'FILE:Store.items'),
    (':Store.get', 'FILE:Store.items', ''),
    (':Store.put', 'FILE:Store.items', 'FILE:Store.last'),
]

CLASS_TREES = [
    (':', 'FILE:Store', False),
    (':', 'FILE:Store > FILE:Service', False),
]

HINTS = [
    (4, 0, 'SELF:op:2', 'show SELF'),
    (5, 0, 'SELF:op:2', 'dataflow SELF'),
    (5, 1, 'SELF:op:9', 'walk SELF --from SELF:op:9 --direction backward'),
    (8, 0, 'SELF:op:1', 'slice SELF --from SELF:op:1'),
    (8, 1, 'SELF:op:2', 'slice SELF --from SELF:op:2'),
    (8, 2, 'SELF:op:3', 'slice SELF --from SELF:op:3'),
    (8, 3, 'SELF:op:4', 'slice SELF --from SELF:op:4'),
    (9, 0, 'SELF:op:3', 'show SELF'),
    (9, 1, 'SELF:op:3', 'show SELF'),
    (10, 0, 'SELF:op:5', 'cfg SELF'),
    (10, 1, 'SELF:op:3', 'slice SELF --from SELF:op:3'),
    (10, 2, 'SELF:op:4', 'slice SELF --from SELF:op:4'),
]

MODULE_REPORTS = [
    (':', 2, '', 0),
    ('pkg/__init__.py:', 0, '', 0),
    ('pkg/core.py:', 1, '', 0),
    ('pkg/late.py:', 1, '', 0),
]

BLOCK_TEXTS = [
    (0, 0, 'bb0: op0:assign x,y; op1:branch  <- x ->bb1 ->bb2'),
    (0, 1, 'bb1: op2:assign z ->bb3'),
    (0, 2, 'bb2: op3:branch  <- y ->bb4 ->bb5'),
    (0, 3, 'bb3: op6:return  <- z end'),
    (0, 4, 'bb4: op4:assign z ->bb3'),
    (0, 5, 'bb5: op5:assign z ->bb3'),
    (1, 0, 'bb0: op0:assign path; op1:assign data ->bb1'),
    (1, 1, 'bb1: op2:assign data <- open,path ->bb4 ~>bb2 ~>bb3 ~>bb5'),
    (1, 2, 'bb2 (handler): op3:enter_except ; op4:assign err; op5:call  <- log,err; op6:raise  ~>bb5'),
    (1, 3, 'bb3 (handler): op7:enter_except ; op8:return  ~>bb5'),
    (1, 4, 'bb4: op9:call  <- check,data ->bb5'),
    (1, 5, 'bb5 (finally): op10:enter_finally ; op11:call  <- tidy,path; op12:exit_finally  ->bb6'),
    (1, 6, 'bb6: op13:return  <- data end'),
    (2, 0, 'bb0: op0:assign lock,items; op1:assign total; op2:enter_with held <- lock ->bb1'),
    (2, 1, 'bb1: op3:other  <- items ->bb2'),
    (2, 2, 'bb2: op4:branch  ->bb3 ->bb5'),
    (2, 3, 'bb3: op5:assign item; op6:branch  <- item ->bb6 ->bb7'),
    (2, 4, 'bb5: op9:assign total <- total,held ->bb8'),
    (2, 5, 'bb6: op7:branch  ->bb2'),
    (2, 6, 'bb7: op8:assign total <- total,item ->bb2'),
    (2, 7, 'bb8 (finally): op10:exit_with ; op11:return  <- total end'),
    (3, 0, 'bb0: op0:assign msg; op1:branch  <- msg ->bb2 ->bb3'),
    (3, 1, 'bb1: op6:return  <- out end'),
    (3, 2, 'bb2: op2:branch steps <- steps; op3:assign out <- steps ->bb1'),
    (3, 3, 'bb3: op4:branch ; op5:assign out ->bb1'),
    (4, 0, 'bb0: op0:assign a,b,c; op1:assign base <- a,b; op2:assign inner <- b,base,c; op3:return  <- inner end'),
    (5, 0, 'bb0: op0:assign n,debug; op1:assign quiet; op2:branch  <- quiet ->bb1 ->bb3'),
    (5, 1, 'bb1: op3:assign n <- n ->bb3'),
    (5, 2, 'bb3: op4:branch  <- n ->bb4 ->bb5'),
    (5, 3, 'bb4: op5:assign n <- n; op6:branch  <- n ->bb6 ->bb3'),
    (5, 4, 'bb5: op8:branch  <- debug ->bb8 ->bb9'),
    (5, 5, 'bb6: op7:branch  ->bb5'),
    (5, 6, 'bb8: op9:branch  <- debug ->bb10 ->bb9'),
    (5, 7, 'bb9: op11:return  <- n end'),
    (5, 8, 'bb10: op10:assign n ->bb9'),
    (6, 0, 'bb0: op0:assign value; op1:branch  <- value ->bb1 ->bb2'),
    (6, 1, 'bb1: op2:raise  <- ValueError,value end'),
    (6, 2, 'bb2: op3:return  <- check,value end'),
    (7, 0, 'bb0: op0:assign value ->bb1'),
    (7, 1, 'bb1: op1:return  <- check,value ~>bb2'),
    (7, 2, 'bb2 (handler): op2:enter_except ; op3:other  ->bb3'),
    (7, 3, 'bb3: op4:return  end'),
    (8, 0, 'bb0: op0:assign box,extra; op1:assign  <- extra,box; op2:call  <- box.append,box,extra; op3:delete  <- box; op4:assign extra.name <- extra; op5:return  end'),
    (9, 0, 'bb0: op0:assign rec; op1:assign name <- rec; op2:assign size <- rec.get,rec; op3:return  <- name,size end'),
    (10, 0, 'bb0: op0:assign flag; op1:branch  <- flag ->bb1 ->bb2'),
    (10, 1, 'bb1: op2:assign found ->bb2'),
    (10, 2, 'bb2: op3:call  <- print,found; op4:return  <- found end'),
    (10, 3, 'bb3: op5:call  <- print,flag; op6:return  end'),
    (11, 0, 'bb0: op0:assign svc; op1:assign s <- Service,svc; op2:call  <- s.put,s,svc; op3:assign t <- s,LIMIT; op4:return  <- svc,t end'),
    ('4.inner', 0, 'bb0: op0:assign k; op1:return  <- k,base,b,c end'),
    (':Service.drop', 0, 'bb0: op0:assign self; op1:other ; op2:other ; op3:assign LIMIT; op4:assign self.last <- again,self; op5:return  end'),
    (':Service.put', 0, 'bb0: op0:assign self,item; op1:call  <- super().put,super,item; op2:call  <- core.size,core,item; op3:assign self.count <- item,self; op4:return  end'),
    (':Store.__init__', 0, 'bb0: op0:assign self,items; op1:assign self.items <- items,self; op2:return  end'),
    (':Store.get', 0, 'bb0: op0:assign self; op1:return  <- self.items,self end'),
    (':Store.put', 0, 'bb0: op0:assign self,item; op1:call  <- self.items.append,self.items,self,item; op2:assign self.last <- item,self; op3:return  end'),
    (':tidy', 0, 'bb0: op0:assign path; op1:call  <- os.remove,os,path; op2:return  end'),
    ('pkg/core.py:check', 0, 'bb0: op0:assign value; op1:branch  <- value ->bb1 ->bb2'),
    ('pkg/core.py:check', 1, 'bb1: op2:raise  <- KeyError,value end'),
    ('pkg/core.py:check', 2, 'bb2: op3:return  <- size,value end'),
    ('pkg/core.py:log', 0, 'bb0: op0:assign err; op1:other ; op2:call  <- print,err; op3:call  <- json.dumps,json,err,again; op4:return  end'),
    ('pkg/core.py:size', 0, 'bb0: op0:assign value; op1:return  <- len,value end'),
    ('pkg/late.py:again', 0, 'bb0: op0:return  <- later end'),
    ('pkg/late.py:later', 0, 'bb0: op0:return  <- again end'),
]
